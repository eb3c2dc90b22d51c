"""Forms that small tables don't reach on their own: split clusters, vocabularies beyond one automaton, approximate indexes, ids by file order."""

import numpy as np
import pytest

from __spark_entry__ import queries
from tessellex.operators import hierarchy, matching, metrics
from tessellex.sources import scans

from .conftest import SMALL


def test_large_clusters_are_split(spark):
    rnd = np.random.default_rng(4)
    rows = [(k, -1, [float(x) for x in rnd.standard_normal(4)]) for k in range(3000)]
    rows += [(5000 + k, 5000, [1.0, 0.0, 0.0, 0.0]) for k in range(700)]  # copies
    rows += [(7000 + k, 7000, [0.0, float(k), 1.0, 0.0]) for k in range(50)]
    df = spark.createDataFrame(rows, "id long, cluster long, v array<double>").repartition(5)
    found = [tuple(r) for r in hierarchy.split_clusters(df, most=200).select("id", "cluster").collect()]
    members = {}
    for i, c in found:
        members.setdefault(c, []).append(i)
    assert sorted(i for i, _ in found) == sorted(i for i, _, _ in rows)
    assert max(map(len, members.values())) <= 200 and sorted(members[7000]) == list(range(7000, 7050))
    was = {i: c for i, c, _ in rows}
    assert all(len({was[i] for i in part}) == 1 for part in members.values())
    assert all(c == 7000 or c == min(part) for c, part in members.items())
    # parts hold what is near: a row is nearer to its own part's centre than to the others', on the whole
    vectors = {i: np.array(v) for i, _, v in rows}
    centres = {c: np.mean([vectors[i] for i in part], axis=0) for c, part in members.items() if was[part[0]] == -1}
    own = np.mean([vectors[i] @ centres[c] for i, c in found if c in centres])
    assert own > 0.5 and abs(np.mean([vectors[i] @ x for i, c in found[:300] if c in centres for x in centres.values()])) < 0.2
    depths = hierarchy.cluster_depths(df, most=200)
    assert depths.count() == len(rows) and depths.filter("depth < 0").count() == 0


def test_density_clusters_prune_and_lose_nothing(spark):
    from pyspark.sql import functions as F

    from tessellex.functions import arrays as A
    from tessellex.session import prepare

    prepare(spark)
    rnd = np.random.default_rng(6)
    n = 1500
    x = rnd.standard_normal((25, 12))[rnd.integers(0, 25, n)] + 0.25 * rnd.standard_normal((n, 12))
    x[:20] = 0  # no direction
    x[20:60] = rnd.standard_normal((40, 12))
    df = spark.createDataFrame([(k, [float(z) for z in v]) for k, v in enumerate(x)], "id long, v array<double>").repartition(4)
    unit = df.select("id", A.normalized(F.col("v")).alias("v"))
    for eps, least, counts in ((0.15, 7, (1, 40)), (1.0, 900, (9, 9))):
        one, many = ({r["id"]: r["cluster"] for r in hierarchy.density_clusters(df, eps, least, chunk=400, cells=c).collect()} for c in counts)
        assert one == many and len(one) == n
        close = (lambda u: u @ u.T >= 1 - eps - 1e-12)(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300))
        cores = np.flatnonzero(close.sum(axis=1) >= least)
        assert {i for i, c in one.items() if c >= 0} == set(np.flatnonzero(close[:, cores].any(axis=1)).tolist())
        # rows share a cluster as cores that reach each other do
        root = {int(c): min(one[int(d)] for d in cores[close[c, cores]]) for c in cores}
        assert all(root[int(c)] == one[int(c)] for c in cores)
    assert len(set(one.values())) <= 2
    visitors, residents = hierarchy.angle_cells(unit, 0.05, 40)
    assert residents.count() == n and hierarchy.met_pairs(visitors, residents) <= 0.25 * n * n
    assert hierarchy.density_clusters(df.limit(0)).collect() == []


def test_retrieval_leaves_out_blocks_that_cannot_reach_the_best(spark):
    from tessellex.operators import retrieval

    rnd = np.random.default_rng(9)
    topic = lambda k: [f"t{k}w{j}" for j in rnd.integers(0, 30, 12)]
    stop = lambda n: [f"s{j}" for j in np.minimum(rnd.zipf(1.5, n), 15)]
    rows = [(i, f"title {i % 40}", " ".join([*topic(i % 40), *stop(25)])) for i in range(1200)] + [(5000, None, None), (5001, "", "s1 s1")]
    docs = spark.createDataFrame(rows, "doc long, title string, body string").repartition(4)
    asked = [(q, " ".join([*topic(q), *stop(4)])) for q in range(25)] + [(90, ""), (91, "nowhere"), (92, None), (93, "s1 s2 s3")]
    queries_ = spark.createDataFrame(asked, "query long, text string")
    links = spark.createDataFrame([(i, i % 3) for i in range(0, 1200, 2)], "doc long, links long")
    fields = {"title": 1.0, "body": 0.5}
    index = retrieval.inverted_index(docs, "doc", fields)
    plain = {(r["token"], r["doc"]): r["s"] for r in retrieval.weighted(index, len(rows), fields).collect()}
    by_token = {}
    for (t, d), s in plain.items():
        by_token.setdefault(t, []).append((d, s))
    for boost in (None, links):
        report = retrieval.Report()
        found = retrieval.bm25(index, len(rows), queries_, fields, 5, boost, block=16, report=report)
        expected = []
        for q, text in asked:
            score = {}
            for t in dict.fromkeys((text or "").split()):
                for d, s in by_token.get(t, ()):
                    score[d] = score.get(d, 0) + s
            own = [(-round(s + (np.log(d % 3 + 1) if boost is not None and d < 1200 and d % 2 == 0 else 0), 9), d) for d, s in score.items()]
            expected += [(q, n, d, -s) for n, (s, d) in enumerate(sorted(own)[:5], 1)]
        rows_ = sorted((r["query"], r["rank"], r["doc"], r["score"]) for r in found.collect())
        assert [r[:2] for r in rows_] == [r[:2] for r in expected] and [r[3] for r in rows_] == pytest.approx([r[3] for r in expected], abs=1e-8)
        assert sum(a[2] != b[2] for a, b in zip(rows_, expected)) <= 2  # ties within rounding
        assert report.every > 0 and report.read <= 0.5 * report.every


def test_vocabularies_that_stay_distributed(spark):
    texts = [(1, "The quick brown fox; the QUICK brown"), (2, "foxes are quick"), (3, ""), (4, None), (5, "a b c a b"), (6, "quickquick brownfox")]
    df = spark.createDataFrame(texts, "k long, t string").repartition(3)
    terms = spark.createDataFrame([("quick",), ("Quick brown",), ("quick brown fox",), ("fox",), ("a b",), ("b",), ("",), ("none of these words",), ("a",)], "term string")
    small, large = (sorted(tuple(r) for r in matching.substring_matches(df, "t", "k", terms, "term", n).select("key", "term", "first").collect()) for n in (100, 0))
    assert small == large and (1, "quick brown", 4) in small and (6, "quick", 0) in small
    tokens = df.selectExpr("k", "split(t, ' ') as w").unionByName(spark.createDataFrame([(7, [])], "k long, w array<string>"))
    one, two = ({r["k"]: [tuple(s) for s in r["spans"]] for r in matching.dictionary_spans(tokens, "k", "w", terms, "term", n).collect()} for n in (100, 0))
    assert one == two and one[1] == [(1, 3), (5, 7)] and one[5] == [(0, 2), (3, 5)] and one[7] == []


def test_long_texts_and_large_vocabularies(spark):
    import time

    rnd = np.random.default_rng(0)
    words = ["".join(rnd.choice(list("abcdé日"), int(k))) for k in rnd.integers(1, 9, 400)]
    df = spark.createDataFrame([(i, " ".join(rnd.choice(words, 40_000))[:160_000]) for i in range(3)] + [(9, "x" * 160_000)], "k long, t string")
    terms = list({" ".join(rnd.choice(words, int(k))) for k in rnd.integers(1, 5, 3000)}) + ["x" * n for n in (1, 7, 64, 1000, 170_000)]
    vocabulary = spark.createDataFrame([(w,) for w in terms], "term string")
    began = time.time()
    large = sorted(tuple(r) for r in matching.substring_matches(df, "t", "k", vocabulary, "term", 0).select("key", "term", "first").collect())
    took = time.time() - began
    lowered = {k: t.lower() for k, t in df.collect()}
    assert large == sorted((k, w, t.find(w)) for k, t in lowered.items() for w in {x.lower() for x in terms} if w in t)
    assert took < 60 and len([r for r in large if r[0] == 9]) == 4
    tokens = df.selectExpr("k", "split(t, ' ') as w")
    one, two = ({r["k"]: [tuple(s) for s in r["spans"]] for r in matching.dictionary_spans(tokens, "k", "w", vocabulary, "term", n).collect()} for n in (10_000, 0))
    assert one == two and len(one[0]) > 1000


def test_a_filter_lets_little_else_through(spark, monkeypatch):
    from tessellex.operators import vocabulary_filter as V
    from tessellex.session import prepare

    prepare(spark)
    rnd = np.random.default_rng(17)
    terms = [f"term {k * k} of {k % 7}" for k in range(5000)]
    held = V.build(spark.createDataFrame([(w,) for w in terms], "term string"), V.letters, sorted({len(w) for w in terms}))
    assert all(0 in at for w in terms[::50] for n, at in held.windows(V.letters(w)) if n == len(w))
    others = [f"form {k * k} at {k % 9}" for k in range(3000)]
    windows = sum(len(w) - n + 1 for w in others for n in {len(x) for x in terms} if n <= len(w))
    assert sum(len(at) for w in others for _, at in held.windows(V.letters(w))) < 0.001 * windows + 50
    text = V.letters(" ".join(terms[k] for k in rnd.integers(0, 5000, 60)))
    whole = sorted((n, int(k)) for n, at in held.windows(text) for k in at)
    monkeypatch.setattr(V, "PIECE", 37)
    assert sorted((n, int(k)) for n, at in held.windows(text) for k in at) == whole and len(whole) >= 60
    x = V.letters("banana banana")
    assert V.Hashes(x).windows(6)[0] == V.Hashes(x).windows(6)[7] != V.Hashes(x).windows(6)[1] and len(V.Hashes(x).windows(99)) == 0


def test_terms_with_one_first_word_are_looked_up(spark):
    import time

    vocabulary = spark.createDataFrame([("alpha " + " ".join(f"w{k % p}" for p in (3, 1009, 50_021)),) for k in range(50_000)], "term string")
    df = spark.createDataFrame([(1, ["Alpha", "w1", "w1", "w1", "alpha"] * 4000)], "k long, w array<string>")
    began = time.time()
    spans = matching.dictionary_spans(df, "k", "w", vocabulary, "term").first()["spans"]
    assert [tuple(s) for s in spans[:2]] == [(0, 4), (5, 9)] and len(spans) == 4000 and time.time() - began < 60


def test_patent_rows_come_in_the_order_of_files(spark, tmp_path):
    for name, rows in (("b.csv", ["9,first of b,A", "1,common,B"]), ("a.csv", ["7,common,A", "3,\"two\nlines\",C", "8,last of a,A"])):
        (tmp_path / name).write_text("publication_number,title,ipc_code\n" + "\n".join(rows) + "\n")
    from tessellex.operators import ids

    titles = ids.title_groups(scans.patents_csv(spark, str(tmp_path)), "title", "publication_number", "ipc_code", "place")
    assert [r["title"] for r in titles.orderBy("patent_id").collect()] == ["common", "two\nlines", "last of a", "first of b"]


@pytest.mark.parametrize("name", ["knn_ivf", "knn_lsh"])
def test_indexes_find_nine_in_ten(spark, name):
    exact = {(r["id"], r["other"]) for r in queries()["knn_exact"](spark, SMALL).collect()}
    found = {(r["id"], r["other"]) for r in queries()[name](spark, SMALL).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_rates_at_k(spark):
    df = spark.createDataFrame([(1,), (2,), (0,), (9,)], "r int")
    rows = {r["k"]: (r["precision"], r["unnormalized"], r["normalized"]) for r in metrics.precision_at(df, "r", [1, 2]).collect()}
    assert rows == {1: (0.25, 0.25, 1 / 3), 2: (0.25, 0.5, 2 / 3)}


def test_one_csv_file_is_read_by_many_tasks(spark, tmp_path):
    import csv

    from tessellex.operators import ids

    rnd = np.random.default_rng(12)
    cells = ["plain", 'say "it"', "two\nlines", "a\n\nb,c", "", " padded ", '"', "\n", 'x""y\n"']
    for name, n in (("b.csv", 900), ("a.csv", 300)):
        with open(tmp_path / name, "w", newline="") as f:
            out = csv.writer(f, quoting=csv.QUOTE_ALL, lineterminator="\r\n" if name == "a.csv" else "\n")
            out.writerow(["publication_number", "title", "ipc_code"])
            for k in range(n):
                out.writerow([f"{name}-{k}", f"{cells[int(rnd.integers(0, 9))]}{k % 250}", cells[int(rnd.integers(0, 9))]])
    (tmp_path / "c.csv").write_text("publication_number,title,ipc_code\n1,no quotes,A\n2,,\n")
    order = lambda df: [tuple(r)[:3] for r in df.orderBy("place").collect()]
    whole = order(scans.patents_csv(spark, str(tmp_path)))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        lines = scans.split_csv_records(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 30 and lines.filter("file like '%b.csv'").count() == 901
        assert order(scans.patents_csv_by_ranges(spark, str(tmp_path))) == whole and len(whole) == 1202
        titles = [[tuple(r)[:2] for r in ids.title_groups(f(spark, str(tmp_path)), "title", "publication_number", "ipc_code", "place").orderBy("patent_id").collect()] for f in (scans.patents_csv, scans.patents_csv_by_ranges)]
        assert titles[0] == titles[1]
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_rows_are_copied_to_chunks_and_not_to_cells(spark):
    from pyspark.sql import functions as F

    from tessellex.functions import arrays as A
    from tessellex.operators import similarity
    from tessellex.session import prepare

    prepare(spark)
    rnd = np.random.default_rng(12)
    df = spark.createDataFrame([(k, [float(z) for z in v]) for k, v in enumerate(rnd.standard_normal((3000, 8)))], "id long, v array<double>")
    unit = df.select("id", A.normalized(F.col("v")).alias("v"))
    known, held = hierarchy._placed(unit, 0.5, 64)
    visitors, residents = hierarchy._grouped(known, 1000)
    assert hierarchy.angle_cells(unit, 0.5, 64)[0].count() > 20 * 3000  # cells would take so many
    assert visitors.count() <= 6 * 3000 and residents.count() == 3000 and len(held.pivots) == 64
    # a chunk is bounded by bytes, so that a large table is copied seldom
    assert similarity.chunk_rows(df) == 1 << 16 and similarity.chunk_rows(df.limit(0)) == 4096
    wide = spark.createDataFrame([(0, [0.0] * 1024)], "id long, v array<double>")
    assert similarity.chunk_rows(wide) == 4096


def test_blocked_top_breaks_ties_by_id_in_every_chunking(spark):
    from pyspark.sql import functions as F

    from tessellex.operators import similarity
    from tessellex.session import prepare

    prepare(spark)
    rnd = np.random.default_rng(13)
    x = rnd.integers(-1, 2, (200, 3)).astype(float)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    wanted = [(i, r + 1, j) for i in range(200) for r, j in enumerate(sorted((j for j in range(200) if j != i), key=lambda j: (-(x[i] @ x[j]), j))[:7])]
    for chunk in (None, 30):
        found = similarity.blocked_top(df.withColumn("block", F.lit(0)), df.withColumn("block", F.lit(0)), 7, chunk=chunk)
        assert sorted((r["id"], r["rank"], r["other"]) for r in found.collect()) == wanted


def test_cosines_of_awkward_vectors(spark):
    from tessellex.operators import similarity
    from tessellex.session import prepare

    prepare(spark)
    rows = [(1, [1.0, 0.0], 0), (2, [0.0, 0.0], 0), (3, None, 0), (4, [2.0, None], 0), (5, [3.0, 4.0], 0), (6, [1.0, 0.0], 1), (7, [1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "id long, v array<double>, block int")
    for chunk in (1, 100):
        found = {(r["id"], r["other"]): r["score"] for r in similarity.cosines(df.filter("id in (1, 3, 6, 7)"), df, chunk).collect()}
        assert found == {(1, 2): 0.0, (1, 3): 0.0, (1, 4): 0.0, (1, 5): pytest.approx(0.6), (3, 1): 0.0, (3, 2): 0.0, (3, 4): 0.0, (3, 5): 0.0}


def test_substring_totals_add_up_what_matches_are(spark):
    from pyspark.sql import functions as F

    from tessellex.session import prepare

    prepare(spark)
    docs = spark.createDataFrame([(1, "Abc abc xÄb"), (2, "zzz"), (3, None), (4, ""), (5, "b" * 500 + "abcb")], "id long, text string")
    words = spark.createDataFrame([("ABC",), ("b",), ("äb",), ("",), (None,), ("bc a",)], "w string")
    hits = matching.substring_matches(docs, "text", "id", words, "w").groupBy("key").agg(F.count("*").alias("terms"), F.sum("first").alias("places"))
    wanted = sorted(map(tuple, hits.collect()))
    assert wanted == [(1, 4, 0 + 1 + 9 + 1), (5, 2, 0 + 500)]
    for terms in (matching.TERMS, 1):
        assert sorted(map(tuple, matching.substring_totals(docs, "text", "id", words, "w", terms).collect())) == wanted
    assert matching.substring_totals(docs, "text", "id", words.limit(0), "w").collect() == []


def test_cosine_pairs_meet_all_rows_of_a_label(spark):
    from tessellex.plans import vectors

    rows = [(20, [1.0, 0.0], 0), (21, [3.0, 4.0], 0), (22, [0.0, 2.0], 0), (23, [1.0, 1.0], 1), (24, [2.0, 2.0], 1), (25, [1.0, 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = {(r["left_id"], r["right_id"]): r["sim"] for r in vectors.cosine_pairs(lambda name: df).collect()}
    half = {(20, 21): 0.6, (20, 22): 0.0, (21, 22): 0.8, (23, 24): 1.0}
    assert found == half | {(b, a): s for (a, b), s in half.items()}


@pytest.mark.parametrize("parts", [1, 4])
def test_substring_totals_of_a_dealt_vocabulary_make_no_row_for_each_match(spark, monkeypatch, parts):
    from tessellex.session import prepare

    prepare(spark)
    texts = ["Solar cell solar  cells  cell", " ab\tab abab ab cd ", "x" * 200 + " " + "x" * 200, "İstanbul ab", ""]
    words = ["cell", "solar cell", "r  c", "ab", "b a", "a", " ", "x" * 70, "b\ta", "cd ", "i̇s"]
    wanted = []
    for k, body in enumerate(x.lower() for x in texts):
        places = [body.find(w) for w in words if w in body]
        wanted += [(k, len(places), sum(places))] if places else []
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    filtered, was = [], matching._filtered
    monkeypatch.setattr(matching, "_filtered", lambda *x: filtered.append(1) or was(*x))
    monkeypatch.setattr(matching, "PARTS", parts, raising=False)
    found = matching.substring_totals(docs, "text", "id", spark.createDataFrame([(w,) for w in words], "w string"), "w", 3)
    assert sorted(map(tuple, found.collect())) == wanted
    assert len(filtered) == (parts == 1)  # rows for each match only beyond PARTS
