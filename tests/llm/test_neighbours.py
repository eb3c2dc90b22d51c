import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tessellex.llm import ann, simhash

from .helpers import ROWS, SMALL, components, documents

# SimHash


def fingerprint(text, width=4):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_by_definition(spark):
    for r in simhash.classes(documents(spark)).collect():
        texts = [t for i, t in ROWS if i == r["doc_id"]]
        assert r["fingerprint"] == f"{fingerprint(texts[0]):016x}"
    hashed = spark.createDataFrame([("some four words here",)], "s string").select(F.xxhash64("s")).first()[0]
    assert hashed == int(np.uint64(fingerprint("some four words here")).view(np.int64))


def test_classes_by_definition(spark):
    rows = simhash.classes(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in rows}
    expected = components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert {r["doc_id"]: r["component_id"] for r in rows} == expected
    assert simhash.classes(documents(spark).limit(0)).collect() == []


@pytest.mark.parametrize("choice", [(5, 1), (6, 2), (7, 3)])
def test_keys_meet_all_within_the_bound(choice):
    rnd = np.random.default_rng(3)
    x = rnd.integers(0, 1 << 63, 400, dtype=np.uint64)
    for errors in range(5):
        y = x.copy()
        for k in range(len(y)):
            for b in rnd.choice(64, errors, replace=False):
                y[k] ^= np.uint64(1 << int(b))
        (ax, kx), (ay, ky) = simhash.keys(x, 4, *choice), simhash.keys(y, 4, *choice)
        own = [set(kx[ax == k].tolist()) for k in range(len(x))]
        other = [set(ky[ay == k].tolist()) for k in range(len(y))]
        assert all(a & b for a, b in zip(own, other))


def test_golay_code_is_perfect():
    heads, patterns, begins = simhash.golay()
    words = np.random.default_rng(1).integers(0, 1 << 23, 500)
    at, index = simhash.nearby_codewords(words)
    codewords = index << 11 | heads[index]
    distance = np.bitwise_count(codewords ^ words[at])
    assert distance.max() == 4 and all((distance[at == k] <= 3).sum() == 1 for k in range(500))


def test_dense_groups_and_blocks(spark):
    rnd = np.random.default_rng(2)
    centre = rnd.integers(0, 1 << 62)
    near = {int(centre)} | {int(centre) ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rnd.integers(0, 60, (300, 2))}
    far = {int(v) for v in rnd.integers(0, 1 << 62, 100)}
    values = sorted(near | far | {0, 3, 15, 255, 4095})
    nodes = spark.createDataFrame([(v, [v], np.uint64(v).tobytes()) for v in values], "node long, words array<long>, code binary").repartition(3)
    expected = components(values, lambda a, b: (a ^ b).bit_count() <= 4)
    for block in (1 << 18, 40):
        edges = simhash.links(nodes, 4, block=block).collect()
        assert all((e["a"] ^ e["b"]).bit_count() <= 4 for e in edges)
        pairs = {(e["a"], e["b"]) for e in edges} | {(e["b"], e["a"]) for e in edges}
        assert components(values, lambda a, b: (a, b) in pairs) == expected


def jaccard(a, b, width=5):
    def shingles(t):
        w = t.lower().split()
        return {" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))}

    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def test_similar_classes_find_near_copies(spark):
    rnd = np.random.default_rng(4)
    words = [f"w{k}" for k in range(5000)]
    rows = []
    for g in range(25):
        text = list(rnd.choice(words, 400))
        rows.append((10 * g, " ".join(text)))
        for c in range(1, 4):
            copy = list(text)
            copy[int(rnd.integers(400))] = "changed"
            rows.append((10 * g + c, " ".join(copy)))
    named = {r["doc_id"]: r["component_id"] for r in simhash.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(named[i] == i - i % 10 for i, _ in rows)
    kept = simhash.representatives(documents(spark)).collect()
    ids = sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in kept)
    assert len(ids) == len(set(ids)) and {9, 0} <= set(ids) and 10 not in ids
    assert simhash.representatives(documents(spark).limit(0)).collect() == []


def edited(rnd, how, share):
    """Two texts of 300 words, of which the second has a passage appended, cut or replaced, or words changed here and there."""
    text = [f"w{k}" for k in rnd.integers(0, 3000, 300)]
    n = round(share * 300)
    new, at = [f"n{k}" for k in rnd.integers(0, 3000, n)], int(rnd.integers(0, 300 - n))
    other = {"appended": text + new, "cut": text[:at] + text[at + n :], "replaced": text[:at] + new[: n // 2] + text[at + n // 2 :]}[how]
    return " ".join(text), " ".join(other)


def passages(low, high):
    """Rows of which 2k and 2k + 1 have a 5-word Jaccard similarity in [low, high), and nothing else is alike."""
    rnd, rows = np.random.default_rng(6), []
    while len(rows) < 120:
        a, b = edited(rnd, ["appended", "cut", "replaced"][len(rows) // 2 % 3], rnd.uniform(0.1, 0.35))
        if low <= jaccard(a, b) < high:
            rows += [(len(rows), a), (len(rows) + 1, b)]
    return rows


def named(spark, rows, **sizes):
    return {r["doc_id"]: r["component_id"] for r in simhash.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"), **sizes).collect()}


def test_similar_classes_lose_no_edited_passage(spark):
    assert named(spark, passages(0.8, 0.85)) == {i: i - i % 2 for i in range(120)}


def test_similar_classes_are_the_same_however_work_is_dealt(spark):
    rows = passages(0.8, 0.85)
    assert named(spark, rows, bucket=2000, chunk=1, hot_texts=10) == {i: i - i % 2 for i in range(120)}


def crowd():
    """Near copies of one text, a chain of texts of which only neighbours are alike, copies, and texts that share a long passage with the first ones and no more."""
    rnd = np.random.default_rng(8)
    text = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join([*text, f"x{k}", f"y{k}"])) for k in range(150)]
    chain = [f"c{k}" for k in range(200)]
    rows += [(200 + k, " ".join(chain[4 * k : 4 * k + 60])) for k in range(20)]
    rows += [(300 + k, " ".join(text[:60] + [f"z{i}" for i in rnd.integers(0, 400, 40)])) for k in range(30)]
    return rows + [(400 + k, " ".join(text)) for k in range(20)]


@pytest.mark.parametrize("sizes", [{}, {"bucket": 3000, "chunk": 16}, {"bucket": 3000, "chunk": 7, "hot_texts": 60}, {"shingles": 2000}])
def test_similar_classes_of_a_crowd(spark, sizes):
    rows = crowd()
    texts = dict(rows)
    assert named(spark, rows, **sizes) == components(list(texts), lambda a, b: jaccard(texts[a], texts[b]) >= 0.8)


def test_long_near_copies_take_bounded_memory():
    """Sets of a block against each other: some 40 bytes a shingle beyond the sets."""
    import tracemalloc

    base = np.arange(20_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sets = [np.sort(np.concatenate([base[k * 10 : 18_000 + k * 10], np.arange(500, dtype=np.uint64) + np.uint64(10**12 + k * 1000)])) for k in range(60)]
    tracemalloc.start()
    edges = simhash.alike(sets, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(edges) == 59 and peak < 48 * sum(map(len, sets))


def test_near_copies_meet_by_simhash(spark, monkeypatch):
    """Without the search among sets: what stays are the classes of fingerprints within four bits that are alike."""
    rows = crowd()
    texts = dict(rows)
    sets = {i: simhash.shingle_set(t, 5) for i, t in rows}
    prints = {i: int.from_bytes(simhash.majority(s), "little") for i, s in sets.items()}
    monkeypatch.setattr(simhash, "near_sets", lambda texts, *_: texts.select("node", "node").toDF("a", "b").limit(0))
    found = named(spark, rows)
    all_near = components(list(texts), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4 and jaccard(texts[a], texts[b]) >= 0.8)
    assert len(set(found.values())) < len({t for _, t in rows})
    assert all(all_near[i] == all_near[found[i]] for i in texts) and found != {i: i for i in texts}


def test_families_leave_nothing_for_the_search_among_sets(spark):
    """Texts that are known to be connected, and share shingles with no other, drop out; another family's near text is found."""
    base = [f"w{k}" for k in range(200)]
    rows = [(k, 1, " ".join([*base, f"x{k}"])) for k in range(1, 6)]
    nodes = spark.createDataFrame([(i, f, t, len(simhash.shingle_set(t, 5))) for i, f, t in rows], "node long, family long, text string, size long")
    assert simhash.near_sets(nodes, 5, 0.8).collect() == []
    apart = nodes.withColumn("family", F.when(F.col("node") == 5, 5).otherwise(F.col("family")))
    assert 5 in {x for e in simhash.near_sets(apart, 5, 0.8).collect() for x in (e["a"], e["b"])}


def test_representatives_go_by_row_and_not_by_id(spark):
    a, b, c = "the first text has some words that no other has at all", "here is a second one unlike it in each of its words", "something else entirely stands written in this last example"
    for rows, stay in (
        ([(7, a), (7, b)], [(7, a), (7, b)]),
        ([(5, a), (7, a), (7, b), (None, a), (None, c)], [(5, a), (7, b), (None, c)]),
        ([(1, a), (1, a), (None, b), (None, b), (None, a)], [(1, a), (None, b)]),
        ([(3, None), (3, ""), (4, "  ")], [(3, None)]),
    ):
        found = [tuple(r) for r in simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
        found = [(i, t or None) for i, t in found]
        assert sorted(found, key=repr) == sorted(stay, key=repr)


def test_similar_classes_keep_what_is_less_alike(spark):
    assert named(spark, passages(0.7, 0.79)) == {i: i for i in range(120)}


# nearest neighbours


def brute(rows, k, asked):
    usable = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for q, own in usable:
        if asked(q):
            scored = sorted((-float((np.array(own, float) * np.array(v, float)).sum()), i) for i, v in usable if i != q and len(v) == len(own))
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return out


def test_neighbours_of_awkward_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (20, [2.0, 1.0]), (20, [2.0, 1.0]), (20, [1.0, 7.0]), (2, [3.0, 0.5]), (40, [1.0, 2.0, 3.0]), (9, [3.0, 2.0, 1.0]), (None, [1.0, 1.0]), (60, [1.0])]
    df = spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], "vec_id long, embedding array<float>, score int, rank string, id int, asks int").repartition(3)
    found = ann.search(df, F.col("vec_id") % 20 == 0, k=3)
    assert sorted(tuple(r) for r in found.collect()) == sorted(brute(rows, 3, lambda q: q % 20 == 0))
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_neighbours_recall(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"])) for r in df.collect()]
    expected = brute(rows, 20, lambda q: q % 20 == 0)
    for blocks in ({}, {"data_block": 60, "query_group": 7}):
        found = [tuple(r) for r in ann.search(df, F.col("vec_id") % 20 == 0, **blocks).collect()]
        assert len(found) == len(expected)
        truth = {(q, i): s for q, _, i, s in expected}
        hit = [(q, i) for q, _, i, _ in found if (q, i) in truth]
        assert len(hit) >= 0.95 * len(truth) and all(s == pytest.approx(truth[q, i], abs=1e-12) for q, _, i, s in found if (q, i) in truth)


@pytest.mark.parametrize("vectors, share", [("random", 0.05), ("table", 0.10)])
def test_codes_leave_few_exact_products(vectors, share):
    if vectors == "table":
        table = pd.read_parquet(SMALL.replace("0.001", "0.1") + "/embeddings.parquet")
        data = np.stack(table["embedding"]).astype(float)
    else:
        data = np.random.default_rng(0).standard_normal((8000, 64))
    ids, asked = np.arange(len(data)), np.arange(0, len(data), 20)
    block = ann.Block(ids, data, *ann.encode(data))
    found = list(block.best(ids[asked], data[asked], 20))
    scores = data[asked] @ data.T
    scores[np.arange(len(asked)), asked] = -np.inf
    truth = {(q, int(i)) for q in range(len(asked)) for i in np.argsort(-scores[q])[:20]}
    assert len(truth & {(q, i) for q, i, _ in found}) >= 0.99 * len(truth)
    assert block.pairs == len(asked) * len(data) and block.computed <= share * block.pairs
