import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessellex.llm import lexical_search as search

from .helpers import ROWS, SMALL, documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def by_definition(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aZé ß.İ\x7f\x00-_9日\n~{"), max_size=40))
def test_terms(text):
    assert [t.decode() for t in search.terms_of(text)] == terms(text)


ITEMS = [(1, "the quick brown fox the fox"), (2, None), (3, ""), (4, "nothing-of-this"), (5, "ONE one"), (None, "river tree owls"), (1, "the quick brown fox the fox"), (7, "日本語のテキスト é")]


@pytest.mark.parametrize("shard, block", [(1, 1 << 20), (30, 300)])
def test_against_all_documents(spark, shard, block):
    items = spark.createDataFrame([(i, t, 1.0, "r") for i, t in ITEMS], "item_id long, text string, score double, rank string")
    ours = search.search(documents(spark), items, k=3, shard=shard, block_bytes=block)
    assert ours.columns == ["item_id", "rank", "doc_id", "score"] and found(ours) == by_definition(ROWS, ITEMS, 3)


def test_ties_and_repeats(spark):
    rows = [(i, "same words here") for i in (9, 4, 4, None, 30, 2)] + [(50 + i, f"other text {i}") for i in range(40)]
    assert found(search.search(documents(spark, rows), spark.createDataFrame([(1, "words same")], "item_id long, text string"), k=4)) == by_definition(rows, [(1, "words same")], 4)


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.search(documents(spark).limit(0), items).collect() == []
    assert search.search(documents(spark), items.limit(0)).collect() == []
    assert search.search(documents(spark, [(1, None), (2, "...")]), items).collect() == []


def test_given_documents(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = by_definition([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert found(search.search(docs.repartition(5), items, shard=4000)) == plain


def test_search_stops_early():
    rnd = np.random.default_rng(2)
    size, vocabulary = 20_000, 200
    terms_ = np.sort(np.argsort(rnd.random((size, vocabulary)), axis=1)[:, :20], axis=1).astype(np.int32).ravel()
    shard = search.Shard(np.arange(size), np.zeros(size, bool), np.full(size, 20), terms_, rnd.geometric(0.002, size * 20).clip(1, 999_999), vocabulary)
    wanted, own = np.array([3, 50, 120]), np.array([5, 4, 9])
    weights = np.zeros(vocabulary, dtype=np.int64)
    weights[wanted] = own
    best = search.Best(10)
    search.search_shard(shard, wanted, weights, own, 0, best)
    scores = (weights[shard.terms] * shard.impacts).reshape(size, 20).sum(axis=1)
    order = np.lexsort((np.arange(size), -scores))[:10]
    assert best.rows[2].tolist() == order.tolist() and best.rows[0].tolist() == scores[order].tolist()
    assert best.scored < size * 0.2
