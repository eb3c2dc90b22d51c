"""Golden rows and awkward cases of single operators, files and streams."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessellex import models
from tessellex.functions import arrays as A
from tessellex.functions import text as T
from tessellex.operators import dedup, graph, ids, joins, matching, metrics, sampling, tagging
from tessellex.sources import scans, sinks
from tessellex.streaming import queries as streams

from .conftest import SMALL


def one(spark, column, *values):
    names = [f"c{k}" for k in range(len(values))]
    return spark.createDataFrame([tuple(values)], names).select(column(*map(F.col, names)).alias("x")).first()["x"]


@pytest.mark.parametrize("given, wanted", [("bread making39s", "bread making"), ("device39", "device"), ("semiconductor device US123456", "semiconductor device"), ("39 a39s39", "a39s"), ("", "")])
def test_clean_phrase(spark, given, wanted):
    assert one(spark, T.clean_phrase, given) == wanted


@pytest.mark.parametrize("given, wanted", [("it ' s here", "it is here"), ("it 's", "it is"), ("do n't go", "do not go"), ("they ' re", "they are"), ("it's", "it's"), ("' s ' s", "is is")])
def test_contractions(spark, given, wanted):
    assert one(spark, T.expand_contractions, given) == wanted


def test_spans(spark):
    assert [one(spark, A.valid_spans, x) for x in ("", "1:0:1", "1:0", "1:0:1,2:3:4", "1:0:1,")] == [True, True, False, True, False]
    assert one(spark, lambda c: A.format_spans(A.parse_spans(c)), "1:0:1, 5:2:3,x,9:8") == "1:0:1,5:2:3"
    assert one(spark, A.parse_set, " b, a,,b ") == ["a", "b"]


def test_remap_keeps_unknown_ids(spark):
    df = spark.createDataFrame([(1, "1:0:1,5:2:3,7:4:5"), (2, "")], "k long, s string").select("k", A.parse_spans(F.col("s")).alias("s"))
    mapping = spark.createDataFrame([(1, 1003), (5, 1007)], "old_id long, new_id long")
    found = {r["k"]: r["x"] for r in joins.remap_spans(df, "s", mapping, "k").select("k", A.format_spans(F.col("s")).alias("x")).collect()}
    assert found == {1: "1003:0:1,1007:2:3,7:4:5", 2: ""}


def test_patent_ids(spark):
    rows = spark.createDataFrame([(n,) for n in (1, 9_999_999, 10_000_000, 10_000_001)], "n long").select(ids.patent_id(F.col("n")).alias("x")).collect()
    assert [r["x"] for r in rows] == ["A0000001", "A9999999", "A10000000", "B0000001"]


def test_dense_ids(spark):
    rows = ids.dense_ids(spark.range(1000).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(1 << 40))).repartition(5), ["k", "id"], "n").collect()
    assert [r["n"] for r in sorted(rows, key=lambda r: (r["k"], r["id"]))] == list(range(1, 1001))
    assert ids.dense_ids(spark.range(0), ["id"], "n").columns == ["id", "n"]


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 700)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    rows = graph.connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in rows} == {n: find(n) for n in root} and len(rows) == len(root)
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_array_functions(spark):
    assert one(spark, lambda v, m: A.left_aligned(v, m, 4, F.lit(0)), [1, 2, 3, 4], [0, 1, 0, 1]) == [2, 4, 0, 0]
    assert one(spark, lambda a, b: A.cosine(a, b), [0.0, 0.0], [1.0, 2.0]) == 0
    assert one(spark, A.normalized, [3.0, 4.0]) == pytest.approx([0.6, 0.8])
    assert one(spark, lambda v: A.mean_of(v, F.lit(1), F.lit(2)), [1.0, 2.0, 4.0]) == 3
    assert one(spark, lambda v, i: A.gather(v, i), ["a", "b"], [1, 0, 5]) == ["b", "a", None]
    assert sum(np.exp(one(spark, A.log_softmax, [1.0, 2.0, 3.0]))) == pytest.approx(1)
    assert one(spark, A.log_sigmoid, -800.0) == pytest.approx(-800)
    assert sum(one(spark, metrics.masked_softmax, [1.0, 9.0, 2.0], [1, 0, 1])) == pytest.approx(1)


def test_context_moves_unused_room(spark):
    df = spark.createDataFrame([([str(k) for k in range(20)], 1, 3)], "t array<string>, s int, e int")
    left, right = T.context(F.col("t"), F.col("s"), F.col("e"), 10)
    assert df.select(left.alias("l"), right.alias("r")).first() == (["0"], ["3", "4", "5", "6", "7", "8", "9"])


def test_matching(spark):
    docs = spark.createDataFrame([(1, "The Data mining of data"), (2, None), (3, "")], "k long, t string")
    words = spark.createDataFrame([("data",), ("DATA mining",), ("absent",), ("",)], "w string")
    for terms in (200, 1):
        found = {(r["key"], r["term"], r["first"]) for r in matching.substring_matches(docs, "t", "k", words, "w", terms).collect()}
        assert found == {(1, "data", 4), (1, "data mining", 4)}
        tokens = docs.select("k", F.split("t", " ").alias("w"))
        spans = {r["k"]: [(s["start"], s["end"]) for s in r["spans"]] for r in matching.dictionary_spans(tokens, "k", "w", words, "w", terms).collect()}
        assert spans == {1: [(1, 3), (4, 5)], 2: [], 3: []}
    tags = tokens.filter("k = 1").select(matching.bio_tags(F.col("w"), F.array(F.struct(F.lit(1).alias("start"), F.lit(3).alias("end")))).alias("x")).first()["x"]
    assert tags == ["O", "B-FOT", "I-FOT", "O", "O"]
    prefix = tagging.single_entity_tags(tokens.filter("k = 1").withColumn("e", F.lit("data min")), "w", "e", "x", prefix=True).first()["x"]
    assert prefix == ["O", "B-FOT", "I-FOT", "O", "O"]


def test_span_matches(spark):
    spans = "array<struct<entity:string,start:int,end:int>>"
    gold = [("Q7366", 14, 18), ("Q780394", 19, 35)]
    df = spark.createDataFrame([(gold, [("Q7366", 14, 16), ("Q780394", 19, 35)]), (gold, []), (None, gold)], f"g {spans}, p {spans}")
    rows = [r["m"] for r in df.select(metrics.span_matches("g", "p").alias("m")).collect()]
    assert [(r["weak"], r["strong"]) for r in rows] == [(2, 1), (0, 0), (0, 0)]


def test_weights_and_decoding(spark):
    assert one(spark, lambda f, w: tagging.adjusted_weight(f, w), 0.4, 1.8) == pytest.approx(1.98)
    assert one(spark, lambda f, w: tagging.adjusted_weight(f, w), 0.9, 1.8) == pytest.approx(1.62)
    decode = tagging.viterbi(np.array([[0.0, 0, -9], [0, -9, 2], [0, 0, 0]]), np.array([0.0, 0, -9]), np.zeros(3))
    assert one(spark, decode, [[0.0, 1.0, 5.0], [0.0, 0.0, 0.5], [1.0, 0.0, 0.0]]) == [1, 2, 0]


def test_union_and_halves(spark):
    a, b = spark.createDataFrame([("x", 1)], "k string, v int"), spark.createDataFrame([("x", 2), ("y", 3)], "k string, v int")
    assert sorted(tuple(r) for r in dedup.union_first([a, b], "k").collect()) == [("x", 1), ("y", 3)]
    assert sorted(tuple(r) for r in sampling.halves(spark.range(5), "id").collect()) == [(0, 1), (1, 1), (2, 1), (3, 2), (4, 2)]
    assert sampling.sample(spark.range(100), "id", 7).count() == 7


def test_models(spark):
    df = spark.createDataFrame([(1, "abc", "abd"), (2, "", "abc"), (3, None, "x")], "k long, a string, b string")
    rows = {r["k"]: r for r in models.apply(df, models.character_encoder(16), ["a"], "v array<double>").collect()}
    native = {r["k"]: r["v"] for r in A.with_hash_code(df, "a", "v", 16).collect()}
    assert all(rows[k]["v"] == pytest.approx(native[k]) for k in rows)
    best = models.rerank(df.withColumn("q", F.lit(0)), models.cosine_pair_scorer(), ["a", "b"], "q", "k", 1).first()
    assert best["k"] == 1


# files


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_delimited_files(spark, tmp_path):
    put(tmp_path / "in" / "b.csv", 'publication_number,title,ipc_code\nUS-1, "A ""quoted"" title" ,A21C\nUS-2,"two\nlines",\n')
    put(tmp_path / "in" / "skip.txt", "x\n")
    rows = {r["publication_number"]: r for r in scans.patents_csv(spark, str(tmp_path / "in")).collect()}
    assert rows["US-2"]["title"] == "two\nlines" and rows["US-2"]["ipc_code"] == "" and len(rows) == 2
    put(tmp_path / "m" / "chunk_1" / "map.tsv", "fot_id\tfot_name\tipc_code\n1\ta\tA\nx\tbad\tB\n")
    put(tmp_path / "m" / "chunk_2" / "map.tsv", "fot_id\tfot_name\tipc_code\n1\tb\tA\n")
    columns = ["fot_id", "fot_name", "ipc_code"]
    assert sorted((r["chunk"], r["fot_name"]) for r in scans.chunk_folders(spark, str(tmp_path / "m"), "map.tsv", columns, ("fot_id",)).collect()) == [("chunk_1", "a"), ("chunk_2", "b")]
    assert scans.chunk_folders(spark, str(tmp_path / "m"), "map.tsv", columns, ("fot_id",), 1).count() == 1
    level = put(tmp_path / "level.txt", "1\tname one\tA,B\nname two\t2\tC\nbroken\n")
    assert sorted((r["id"], r["name"], tuple(r["ipc_codes"])) for r in scans.level_file(spark, level).collect()) == [(1, "name one", ("A", "B")), (2, "name two", ("C",))]


def test_json_and_triples(spark, tmp_path):
    array, lines = put(tmp_path / "a.json", json.dumps([{"name": "x", "id": 1}, {"name": "y", "id": 2}])), put(tmp_path / "l.jsonl", '{"name": "x", "id": 1}\nbroken\n{"name": "y", "id": 2}\n')
    for path in (array, lines):
        assert sorted((r["name"], r["id"]) for r in scans.json_records(spark, path, "name string, id int").collect()) == [("x", 1), ("y", 2)]
    catalog = put(tmp_path / "entity.jsonl", "".join(json.dumps({"title": t, "text": "t", "idx": f"https://en.wikipedia.org/wiki?curid={9 + k}"}) + "\n" for k, t in enumerate("aba")))
    rows = scans.entity_catalog(spark, catalog)
    assert sorted((r["id"], r["title"], r["page_id"]) for r in rows.collect()) == [(0, "a", 9), (1, "b", 10), (2, "a", 11)]
    assert sorted(tuple(r) for r in scans.last_by_title(rows).collect()) == [("a", 2), ("b", 1)]
    nt = put(tmp_path / "x.nt", '<s> <p/name> "Data mining"^^<t> .\n<s> <q> <o> .\nshort\n')
    assert [r["literal"] for r in scans.triples(spark, nt, "name").collect()] == ["Data mining"]
    for text in ('["a", "b"]', '[{"name": "a"}, {"name": "b"}]', '{"level2": ["a"], "level3": ["b"]}'):
        assert sorted(one(spark, scans.names_of, text)) == ["a", "b"]


def test_wiki_files(spark, tmp_path):
    wiki = put(tmp_path / "w", '<doc id="1" url="u?curid=1" title="A">\nA\n\nFirst <a href="B%20c">bee</a>.\n\nRest\n</doc>\n<doc id="2" url="u" title="B">\nB\n</doc>\n')
    rows = {r["id"]: r for r in scans.wiki_extracts(spark, wiki).collect()}
    assert rows["1"]["links"][0] == ("B c", "bee") and rows["1"]["intro_lines"][:3] == ["A", "", 'First <a href="B%20c">bee</a>.'] and set(rows) == {"1", "2"}
    dump = put(tmp_path / "d.json", "[\n" + json.dumps({"id": "Q1", "sitelinks": {"enwiki": {"title": "U"}}, "labels": {"en": {"value": "u"}}, "aliases": {"en": [{"value": "v"}]}}) + ",\n" + json.dumps({"id": "Q2"}) + "\n]\n")
    assert [(r["id"], r["title"], r["aliases"]) for r in scans.wikidata_dump(spark, dump).collect()] == [("Q1", "U", ["v"])]


def test_mention_files(spark, tmp_path):
    conll = put(tmp_path / "c", "-DOCSTART- (1 x)\nEU\tB\tEU\nrejects\n\nGerman\tB\n-DOCSTART- (2 y)\nPeter\tB\nBlackburn\tI\n")
    rows = sorted((r["doc"], r["sentence"], r["tokens"], r["tags"]) for r in scans.conll(spark, conll).collect())
    assert rows == [("1 x", 0, ["EU", "rejects"], ["B", "O"]), ("1 x", 1, ["German"], ["B"]), ("2 y", 0, ["Peter", "Blackburn"], ["B", "I"])]
    table = put(tmp_path / "m.tsv", "d\td\tParis\tleft\tright\tCANDIDATES\t1,0.9,Paris\t2,0.1,Paris, Texas\tGT:\t0,1,Paris\nd\td\tX\tl\tr\tCANDIDATES\tEMPTYCAND\tGT:\t-1\n")
    found = {r["mention"]: r for r in scans.mention_table(spark, table).collect()}
    assert found["Paris"]["candidates"] == [("Paris", 0.9), ("Paris, Texas", 0.1)] and found["Paris"]["gold"] == "Paris" and found["X"]["candidates"] == []
    docs = spark.createDataFrame([("d", "a b c d e")], "document_id string, text string")
    mentions = spark.createDataFrame([("d", "l", 2, 2)], "context_document_id string, label_document_id string, start_index int, end_index int")
    assert tuple(scans.window_examples(docs, mentions, 3).first())[2:] == ("c", "b", "d")


def test_sinks_and_vectors(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", ["c", "b"]), (2, "b", [])], "id long, name string, codes array<string>")
    sinks.write_tsv(df.coalesce(1), str(tmp_path / "t"))
    assert sorted(tuple(r) for r in scans.tsv(spark, str(tmp_path / "t"), ["id", "name", "codes"], ("id",)).collect()) == [(1, "a", "b,c"), (2, "b", "")]
    sinks.write_json_lines(df, str(tmp_path / "j"), "name")
    assert sorted(p.name for p in (tmp_path / "j").glob("name=*")) == ["name=a", "name=b"]
    sinks.write_index(df.withColumn("title", F.lit("x y")), "id", {"title": 1.0}, str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).count() == 4
    encode = lambda rows: rows.select("id", F.array(F.col("id").cast("double")).alias("v"))
    assert scans.stored_vectors(spark, str(tmp_path / "v"), df.filter("id = 1"), encode).count() == 1
    assert scans.stored_vectors(spark, str(tmp_path / "v"), df, encode).count() == 2
    assert spark.read.parquet(str(tmp_path / "v")).count() == 2
    sinks.write_vectors(spark.read.parquet(str(tmp_path / "v")).withColumn("cell", F.lit(0)), str(tmp_path / "c"), "cell")


# streams


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = streams.read_folder(spark, str(tmp_path / "e"), events, 10)
    batch = {tuple(r) for r in streams.event_counts(events).collect()}
    live = {tuple(r) for r in streams.run_once(streams.event_counts(stream, late="400 days"), str(tmp_path / "o1"), str(tmp_path / "c1"), "complete").collect()}
    assert live == batch
    users = {tuple(r) for r in streams.run_once(streams.sessions(stream, late="400 days"), str(tmp_path / "o2"), str(tmp_path / "c2"), "complete").collect()}
    assert users == {tuple(r) for r in streams.sessions(events).collect()}
    types = streams.run_once(streams.first_titles(stream, "event_type", "ts", "400 days"), str(tmp_path / "o3"), str(tmp_path / "c3"))
    assert types.count() == events.select("event_type").distinct().count()
    step = streams.upsert_vectors(str(tmp_path / "u"), lambda rows: rows.select("id", F.array(F.lit(1.0)).alias("v")))
    step(spark.range(3), 0)
    step(spark.range(5), 1)
    assert spark.read.parquet(str(tmp_path / "u")).count() == 5


def test_record_filters(spark):
    from tessellex.operators import filters

    pages = spark.createDataFrame([("A", "x", 5, ["p", "q"], "q"), ("B (disambiguation)", None, 50, ["p"], "q"), ("C", "a disambiguation page", 7, None, "p"), (None, None, None, [], None)], "title string, description string, n int, c array<string>, g string")
    assert [r["title"] for r in filters.without_disambiguation(pages).collect()] == ["A", None]
    assert [r["title"] for r in filters.long_enough(pages, "n", 7).collect()] == ["B (disambiguation)", "C"]
    assert filters.gold_within(pages, "c", "g").count() == 1 and filters.gold_within(pages, "c", "g", 1).count() == 0
    spans = spark.createDataFrame([(0, 3, -1.0, -2.0), (4, 3, -1.0, -1.0), (0, 30, -3.0, -1.0)], "start int, end int, joint double, mention double")
    assert filters.fair_spans(spans, "start", "end", 10).count() == 1
    assert [filters.passing(spans, m, -1.5).count() for m in ("joint", "mention", "both")] == [2, 2, 1]
    rows = spark.createDataFrame([("s1", "p/level", "0"), ("s1", "p/name", "Data"), ("s2", "p/level", "3"), ("s2", "p/name", "Ink"), ("s3", "p/level", "1"), ("s3", "p/name", "Unknown")], "subject string, predicate string, literal string")
    known = spark.createDataFrame([("Data",), ("Ink",)], "title string")
    assert [tuple(r) for r in filters.levels_in_catalog(rows, known, "level").collect()] == [("s1", "Data")]
    tags = spark.createDataFrame([(["DET", "NOUN"],), (["NOUN", "ADJ"],)], "t array<string>")
    assert [r["x"] for r in tags.select(filters.boundary_tags_fit(F.col("t")).alias("x")).collect()] == [False, True]


def test_graph_classifier_learns(spark):
    from tessellex.operators import mentions

    links = spark.createDataFrame([(c, f"{'a' if c % 2 else 'b'}{k}", k) for c in range(12) for k in range(4)], "c long, t string, o int")
    edges = mentions.star_edges(links, "c", "t", "o", 3, negatives=1)
    assert edges.filter("label = 1").count() == 36 and edges.filter("label = 0").count() == 36
    vectors = spark.createDataFrame([(f"{s}{k}", [1.0 if s == "a" else -1.0, float(k)]) for s in "ab" for k in range(4)], "node string, v array<double>")
    own = edges.filter("label = 1").select("graph", "node")
    train = spark.createDataFrame([(str(c), c % 2) for c in range(8)], "graph string, label int")
    model, pooled = mentions.graph_classifier(vectors, own, train)
    found = {r["graph"]: r["prediction"] for r in model.transform(pooled).collect()}
    assert all(found[str(c)] == c % 2 for c in range(12))


def test_small_text_forms(spark):
    from tessellex.operators import mentions
    from tessellex.operators.similarity import top_of

    df = spark.createDataFrame([("a b c d", "e f g", ["x😀", "", "y z"], ["w1", "w2"], ["O", "B-FOT"], [0.2, 0.9, 0.9], ["p", "q", "r"])], "l string, r string, al array<string>, w array<string>, t array<string>, s array<double>, n array<string>")
    left, right = mentions.last_and_first_words(F.col("l"), F.col("r"), 2, 1)
    row = df.select(left.alias("l"), right.alias("r"), mentions.quoted_aliases(F.col("al")).alias("al"), mentions.annotated(F.col("w"), F.col("t")).alias("an"), top_of(F.col("s"), F.col("n"), 2).alias("top")).first()
    assert tuple(row) == ("c d", "e", '"x" "y z"', "w1 [B:w2]", ["q", "r"])
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "k long, o int, v string")
    assert {r["k"]: r["vs"] for r in scans.in_order(rows, "k", "o", "v", "vs").collect()} == {1: ["a", "b"], 2: ["c"]}
    assert sampling.first_rows(rows, "k", "o", 1).count() == 2
    assert one(spark, T.page_id, "https://en.wikipedia.org/wiki?curid=42") == 42 and one(spark, T.title_case, "44th x-y") == "44Th X-Y"
    nested = spark.createDataFrame([("US-1", [("Titel", "de"), ("Title", "en")], [("A21C",), ("A22C",)])], "publication_number string, title_localized array<struct<text:string,language:string>>, ipc array<struct<code:string>>")
    assert sorted(tuple(r) for r in scans.nested_export(nested).collect()) == [("US-1", "Title", "A21C"), ("US-1", "Title", "A22C")]


def test_ids_outlive_runs(spark, tmp_path):
    from tessellex.streaming import ledger

    head = "publication_number,title,ipc_code\n"
    put(tmp_path / "in" / "2024-02.csv", head + '3,"two\nlines",A\n4, common ,B\n5,,C\n')
    put(tmp_path / "in" / "2024-01.csv", head + "1,common,A\n2,first,A\n")
    for folder in ("one", "two"):  # a single run, and the same files in two
        if folder == "two":
            put(tmp_path / "late" / "2024-02.csv", (tmp_path / "in" / "2024-02.csv").read_text())
            put(tmp_path / "late" / "2024-01.csv", (tmp_path / "in" / "2024-01.csv").read_text())
        source = str(tmp_path / ("in" if folder == "one" else "late"))
        ledger.run(spark, source, str(tmp_path / folder))
        before = sorted(map(tuple, ledger.library(spark, str(tmp_path / folder)).collect()))
        assert before == [("A0000001", "common", ["1", "4"], ["A", "B"]), ("A0000002", "first", ["2"], ["A"]), ("A0000003", "two\nlines", ["3"], ["A"])]
        put(tmp_path / ("in" if folder == "one" else "late") / "2024-03.csv", head + "6,new,D\n7,first,E\n6,common,A\n")
        ledger.run(spark, source, str(tmp_path / folder))
        ledger.run(spark, source, str(tmp_path / folder))  # nothing new
        after = sorted(map(tuple, ledger.library(spark, str(tmp_path / folder)).collect()))
        assert after == [("A0000001", "common", ["1", "4", "6"], ["A", "B"]), ("A0000002", "first", ["2", "7"], ["A", "E"]), ("A0000003", "two\nlines", ["3"], ["A"]), ("A0000004", "new", ["6"], ["D"])]
    # a batch that runs again after a failure writes the same
    again = spark.createDataFrame([("6", "new", "D", "x")], "publication_number string, title string, ipc_code string, file string")
    ledger.book(str(tmp_path / "one"))(again, 1)
    assert ledger.library(spark, str(tmp_path / "one")).filter("title = 'new'").first()["patent_id"] == "A0000004"


def test_lookups_of_rows_that_move(spark):
    df = spark.range(300).withColumn("_row", F.lit("own")).withColumn("_place", F.lit(1)).repartition(7).filter(F.rand(3) < 2)
    table = spark.createDataFrame([(f"k{k}", k) for k in range(0, 300, 3)] + [(f"m{k}", -k) for k in range(0, 300, 2)], "key string, value long")
    found = joins.lookup_cascade(df, [F.concat(F.lit("k"), "id"), F.lit(None), F.concat(F.lit("m"), "id")], table, "key", "value", "hit")
    assert found.columns == ["id", "_row", "_place", "hit"]
    assert {r["id"]: r["hit"] for r in found.collect()} == {k: k if k % 3 == 0 else -k if k % 2 == 0 else None for k in range(300)}


def test_marginals_over_all_paths(spark):
    from itertools import product

    rnd = np.random.default_rng(14)
    weights = rnd.standard_normal((3, 3)), rnd.standard_normal(3), rnd.standard_normal(3)
    rows = [(k, rnd.standard_normal((n, 3)).tolist(), [int(x) for x in rnd.integers(0, 3, n)]) for k, n in enumerate((1, 2, 6, 3, 6, 1))] + [(10, [], []), (11, None, None), (12, [[0.0, 1.0, 2.0]], [1, 1]), (13, [[900.0, 0.0, -900.0]] * 3, [0, 0, 0])]
    df = spark.createDataFrame(rows, "k long, e array<array<double>>, g array<int>").coalesce(1)
    found = {r["k"]: r for r in df.select("k", tagging.forward_backward(*weights)("e").alias("f"), tagging.path_score(*weights)("e", "g").alias("p")).collect()}
    t, start, end = weights

    def score(e, path):
        return start[path[0]] + sum(e[i][c] for i, c in enumerate(path)) + sum(t[a][b] for a, b in zip(path, path[1:])) + end[path[-1]]

    for k, e, g in rows[:6] + rows[9:]:
        every = {p: score(e, p) for p in product(range(3), repeat=len(e))}
        top = max(every.values())
        z = top + np.log(sum(np.exp(s - top) for s in every.values()))
        assert found[k]["f"]["log_partition"] == pytest.approx(z) and found[k]["p"] == pytest.approx(score(e, g))
        for i in range(len(e)):
            assert found[k]["f"]["marginals"][i] == pytest.approx([sum(np.exp(s - z) for p, s in every.items() if p[i] == c) for c in range(3)], abs=1e-9)
    assert [(found[k]["f"]["log_partition"], found[k]["f"]["marginals"], found[k]["p"]) for k in (10, 11)] == [(0.0, [], None)] * 2 and found[12]["p"] is None


def test_html_text_leaves_unfinished_references_as_its_sql_does(spark):
    import duckdb

    from tessellex import catalog
    from tessellex.plans import texts

    catalog.queries()
    rows = [(1, "a&amp"), (2, "b &ampp &am &quot x&copy=1"), (3, "&amp;lt;&eacute;&#39;&nbsp;&#x41;"), (4, None), (5, "<a\rb>c<d\u2028e>f<g\nh>i&lt;j&gt;"), (6, "")]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    wanted = con.execute(catalog.oracle_sql()["html_text"]).fetchall()
    pages = spark.createDataFrame(rows, "page_id long, html string")
    assert sorted(map(tuple, texts.html_text(lambda name: pages).collect())) == sorted(wanted)
    assert one(spark, T.strip_html, "<b>&eacute;&ampx") == "\xe9&x"


def test_hash_encode_computes_each_different_name_once(spark):
    from tessellex.plans import vectors

    rows = [("Ab ba",), ("Ab ba",), ("",), (None,), ("zäz",)]
    part = spark.createDataFrame(rows, "p_name string")
    found = vectors.hash_encode(lambda name: part)
    dense = A.with_hash_code(part.distinct().withColumnRenamed("p_name", "name"), "name", "v").collect()
    assert sorted(map(tuple, found.collect())) == sorted((r["name"], k, round(w, 6)) for r in dense for k, w in enumerate(r["v"]) if w)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate") :].split("\n", 1)[1]  # its own expressions are computed for what comes out
    assert "lambda" in plan and "lambda" not in below


def test_first_rows_of_equal_places_are_the_same_in_every_order(spark):
    from tessellex.plans import files

    # 100000 + 100005 = 200000 + 5: place doesn't tell these lines apart
    rows = [(1, 2, 5), (1, 1, 100_005), (1, 1, 7)]
    found = [sorted(map(tuple, files.first_candidates(lambda name: spark.createDataFrame(r, "l_orderkey long, l_linenumber int, l_partkey long").coalesce(1)).collect())) for r in (rows, rows[::-1], rows[1:] + rows[:1])]
    assert found == [[(1, 1, 7), (1, 1, 100_005)]] * 3


def test_log_partition_is_finite_where_plain_exponentials_overflow(spark):
    from tessellex.plans import files

    lines = spark.createDataFrame([(1, 1, 600_000, 1, 1.0)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double")
    row = files.crf_marginals(lambda name: lines).first()
    assert np.isfinite(row["log_partition"]) and 0 <= row["first_marginal"] <= 1 and row["path_score"] <= row["log_partition"]


def test_viterbi_walks_the_sequences_of_a_batch_together(spark):
    rnd = np.random.default_rng(5)
    transitions, start, end = rnd.integers(-2, 3, (3, 3)).astype(float), np.array([0.0, 1.0, 0.0]), np.array([0.0, 0.0, 1.0])

    def plain(e):
        score, back = start + e[0], []
        for row in e[1:]:
            every = score[:, None] + transitions
            back.append(every.argmax(axis=0))
            score = every.max(axis=0) + row
        path = [int((score + end).argmax())]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        return path[::-1]

    sequences = [rnd.integers(-2, 3, (int(n), 3)).astype(float) for n in rnd.integers(1, 9, 60)]
    wanted = [plain(e) for e in sequences] + [[], []]
    given = pd.Series([list(e) for e in sequences] + [[], None])
    calls, together = [], tagging._together
    tagging._together = lambda each: calls.append(len(each)) or together(each)
    try:
        assert [list(x) for x in tagging.viterbi(transitions, start, end).func(given)] == wanted
    finally:
        tagging._together = together
    assert calls == [62]
