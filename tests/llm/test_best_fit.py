import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessellex.llm import best_fit

from .helpers import ROWS, SMALL, documents

JSON = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(JSON)


@lru_cache(maxsize=None)
def whole(text):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


def check(rows, docs, capacity):
    """Every id once, pieces as the contract cuts them, sequences gapless and within the capacity; returns the number of sequences."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces) == set(docs)
    for doc, text in docs.items():
        ids, at = whole(text), 0
        for number, r in enumerate(sorted(pieces[doc], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (number, at) and (number == 0 or r["length"] == capacity)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids) and len(pieces[doc]) == max(1, -(-len(ids) // capacity))
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= capacity
    return len(sequences)


def by_definition(lengths, capacity):
    """Gaps of the bins that placing each length where the whole sum of squares is smallest leaves, the sum computed anew for each choice."""
    gaps = []
    for size in lengths:
        choices = []
        for gap in sorted({g for g in gaps if g >= size} | {capacity}):
            after = list(gaps)
            if gap < capacity:
                after.remove(gap)
            after.append(gap - size)
            total = sum(after.count(h) ** 2 for h in range(1, capacity))
            choices.append((total, gap == capacity, gap, after))
        gaps = min(choices)[3]
    return sorted(gaps)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=40))
def test_sums_of_squares_by_definition(lengths):
    bins = best_fit.sums_of_squares(np.array(lengths, dtype=np.int64), 12)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert sorted(12 - sum(lengths[i] for i in b) for b in bins) == by_definition(lengths, 12)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_packed_is_within_the_capacity_and_no_worse_than_either(lengths):
    falling = np.array(sorted(lengths, reverse=True), dtype=np.int64)
    bins = best_fit.packed(falling, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(falling)))
    assert all(falling[b].sum() <= 50 for b in bins)
    assert len(bins) <= len(best_fit.sums_of_squares(falling, 50))


def test_pieces():
    assert best_fit.cuts(1, 4) == [(0, 1)] and best_fit.cuts(4, 4) == [(0, 4)] and best_fit.cuts(8, 4) == [(0, 4), (4, 8)]
    assert best_fit.cuts(9, 4) == [(0, 1), (1, 5), (5, 9)]


@pytest.mark.parametrize("pieces", [5, 1000])
def test_round_trip(spark, pieces):
    rows = {i: t for i, t in ROWS if i != 2}
    found = best_fit.pack(documents(spark, list(rows.items())), JSON, capacity=64, pieces=pieces)
    assert found.columns == [x.split()[0] for x in best_fit.PLACED.split(", ")]
    check(found.collect(), rows, 64)


def test_documents_take_few_sequences(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = best_fit.pack(docs.repartition(7), JSON).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    least = -(-sum(len(whole(t)) for t in texts.values()) // 2048)
    assert check(rows, texts, 2048) <= least + 1
    assert rows == best_fit.pack(docs.repartition(3), JSON).collect()  # however the rows come


def test_odd_tables(spark):
    assert best_fit.pack(documents(spark).limit(0), JSON).collect() == []
    rows = best_fit.pack(documents(spark, [(1, "a b c"), (1, "a b c"), (None, None)]), JSON).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in rows) == [(0, 1), (1, len(whole("a b c"))), (1, len(whole("a b c")))]
    assert {r["sequence_id"] for r in rows} == {0} and len({r["offset"] for r in rows}) == 3
    clashing = spark.createDataFrame([(1, "a b", 5, "x", 2)], "doc_id long, text string, piece int, sequence_id string, offset int")
    assert best_fit.pack(clashing, JSON).first()["offset"] == 0
    assert best_fit.lower_bound(best_fit.pack(clashing, JSON)).first().asDict() == {"sequences": 1, "tokens": len(whole("a b")), "least": 1}
