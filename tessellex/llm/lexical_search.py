"""The best documents of each query by a weighted sum over shared terms, without scoring all of them."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.staging import held_bytes, stage
from .columns import named

#: Term letters are all but these ASCII ones; A to Z are lower-cased, and only these.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Bytes of the queries' texts that one pass over the documents takes.
BLOCK_BYTES = 8 << 20
#: Pairs of a document and a term in one shard's lists.
SHARD = 2_000_000
#: Entries of each list that the first round of a search takes; each later round takes half as many more.
STRIDE = 32
#: Impacts are below this: a million, in thousandths of the most that a term can add.
IMPACTS = 1 << 20
FORWARD = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])
FOUND = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms_of(text: str) -> list[bytes]:
    """The terms of a text, in order, as UTF-8."""
    return text.encode("utf-8", "replace").translate(_LETTERS).split()


def impact(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What a unit of weight counts for tf occurrences in a document of n terms, of so many documents with so many terms in all."""
    m = 25 + (75 * n * documents) // total
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Shard:
    """Documents with their lists: forward (a document's terms) and, for each term, documents by falling impact."""

    def __init__(self, doc_id: np.ndarray, null: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray, vocabulary: int):
        self.doc_id, self.null, self.terms, self.impacts = doc_id, null, terms, impacts
        self.begins = np.concatenate([[0], np.cumsum(sizes)])
        order = np.argsort(terms.astype(np.int64) * IMPACTS + (IMPACTS - 1 - impacts), kind="stable")
        self.listed = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        self.falling = impacts[order]
        self.lists = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=vocabulary))])
        self.seen = np.full(len(sizes), -1, dtype=np.int64)

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Whole scores of documents, looked up in their forward lists. Every one of them has a term."""
        sizes = self.begins[docs + 1] - self.begins[docs]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.begins[docs] - (ends - sizes), sizes)
        return np.add.reduceat(weights[self.terms[at]] * self.impacts[at], ends - sizes)


class Best:
    """The k best (score, doc_id) so far; of equal scores the smaller doc_id, null last."""

    def __init__(self, k: int):
        self.k, self.rows, self.scored = k, [np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)], 0

    def add(self, scores: np.ndarray, null: np.ndarray, doc_id: np.ndarray) -> None:
        self.scored += len(scores)
        rows = [np.concatenate(x) for x in zip(self.rows, (scores, null, doc_id))]
        order = np.lexsort((rows[2], rows[1], -rows[0]))[: self.k]
        self.rows = [x[order] for x in rows]

    @property
    def floor(self) -> int:
        """The k-th score; 0 while there are fewer, which no document that counts has."""
        return int(self.rows[0][-1]) if len(self.rows[0]) == self.k else 0


def search_shard(shard: Shard, terms: np.ndarray, weights: np.ndarray, own: np.ndarray, stamp: int, best: Best) -> None:
    """Fagin's threshold algorithm over one shard, for the terms of one query.

    weights has every term's weight in the query, own those of ``terms``. Each round takes the next
    entries of every term's list in turn, looks up the whole score of each document not seen yet, and
    stops when the threshold, the score of a document that would have each list's last impact, is
    strictly below the k-th score: a document not seen can't have more than it.
    """
    at, ends, stride = shard.lists[terms], shard.lists[terms + 1], STRIDE
    while True:
        more = at < ends
        if not more.any():
            return
        # the impacts where the lists go on: nothing that isn't seen has more
        threshold = int((own[more] * shard.falling[at[more]]).sum())
        if threshold < best.floor or threshold == 0:
            return
        upto = np.minimum(at + stride, ends)
        docs = np.unique(np.concatenate([shard.listed[a:b] for a, b in zip(at.tolist(), upto.tolist()) if a < b]))
        docs = docs[shard.seen[docs] != stamp]
        if len(docs):
            shard.seen[docs] = stamp
            scores = shard.scores(docs, weights)
            good = (scores > 0) & (scores >= best.floor)
            best.scored += int(len(docs) - good.sum())
            best.add(scores[good], shard.null[docs[good]], shard.doc_id[docs[good]])
        at, stride = upto, stride + stride // 2


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, shard: int = SHARD) -> DataFrame:
    """(item_id, rank, doc_id, score): of each row of items the k documents of the highest score above 0.

    Terms are what ASCII characters other than letters and digits part, A to Z lower-cased. Each term
    of a query, repeats included, adds its weight (by the documents that hold it) times its impact in
    the document (by its occurrences and the document's terms; see ``weight`` and ``impact``); counts
    are over all rows of docs whose text has a term. Equal scores rank by ascending doc_id, null
    last. A null text, or one without a term, finds nothing and is never found. Repeated rows of docs
    rank each for itself, and each row of items is searched for itself. Other columns of either table
    don't matter; empty tables give no rows.

    Queries go to the workers in blocks of about ``block_bytes`` of text. For each block the documents
    are read once and written as forward lists of the block's terms alone; a task then sorts the
    impact lists of ``shard`` pairs at a time and searches them for all queries of the block, with the
    k best so far as the floor of the next shard. The best of all tasks meet in two steps.
    """
    asked = stage(items.select(named(item_id).alias("item_id"), named(item_text).alias("text"), F.monotonically_increasing_id().alias("item")).filter("text is not null"), "items")
    blocks = max(1, -(-held_bytes(asked) // block_bytes))
    source = docs.select(named(doc_id).cast("long").alias("doc_id"), named(text).alias("text"))
    parts = [_search_block(source, asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), k, shard) for b in range(blocks)]
    every = reduce(DataFrame.unionByName, parts)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    top = lambda f, *by: f.withColumn("rank", F.row_number().over(W.Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
    # first the best of a sixty-fourth of the documents, so that no task gets an item's rows of all tasks
    best = top(top(every.withColumn("deal", F.pmod(F.xxhash64("doc_id"), F.lit(64))), "item", "deal"), "item")
    return best.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _search_block(source: DataFrame, asked: DataFrame, k: int, most: int) -> DataFrame:
    queries = [(r["item"], Counter(terms_of(r["text"]))) for r in asked.select("item", "text").collect()]  # bounded by block_bytes
    numbers = {t: i for i, t in enumerate(sorted(set().union(*(q for _, q in queries))))}

    def forward(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows: tuple[list, ...] = ([], [], [], [])
            for doc, body in zip(part["doc_id"].to_pylist(), part["text"]):
                words = terms_of(body.as_py() or "")
                if words:
                    held = sorted((numbers[t], c) for t, c in Counter(words).items() if t in numbers)
                    for column, value in zip(rows, (doc, len(words), [t for t, _ in held], [c for _, c in held])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, FORWARD)], schema=FORWARD)

    lists = stage(source.mapInArrow(forward, "doc_id long, n long, terms array<int>, tfs array<int>"), "forward")
    documents, total = lists.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.full(len(numbers), 0, dtype=np.int64)
    for r in lists.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each of the block's terms at most
        weights[r["term"]] = weight(documents, r["count"])
    plans = []
    for item, q in queries:
        terms = np.array(sorted(numbers[t] for t in q), dtype=np.int64)
        own = weights[terms] * np.array([n for _, n in sorted((numbers[t], n) for t, n in q.items())], dtype=np.int64)
        plans.append((item, terms[own > 0], own[own > 0]))

    def searched(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in plans]
        dense = np.zeros(len(numbers), dtype=np.int64)
        held: list[pa.RecordBatch] = []

        def run() -> None:
            batch = pa.Table.from_batches(held).combine_chunks()
            sizes = np.diff(batch["terms"].chunk(0).offsets.to_numpy())
            terms, tfs = (batch[c].chunk(0).flatten().to_numpy() for c in ("terms", "tfs"))
            impacts = impact(tfs.astype(np.int64), np.repeat(batch["n"].to_numpy(), sizes), documents, total)
            ids = batch["doc_id"].chunk(0)
            some = Shard(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), sizes, terms, impacts, len(numbers))
            for number, ((_, wanted, own), b) in enumerate(zip(plans, best)):
                dense[wanted] = own
                search_shard(some, wanted, dense, own, number, b)
                dense[wanted] = 0

        pairs = 0
        for part in parts:
            part = part.filter(pc.greater(pc.list_value_length(part["terms"]), 0))
            if part.num_rows:
                held.append(part)
                pairs += len(part["terms"].flatten())
            if pairs >= most:
                run()
                held, pairs = [], 0
        if held:
            run()
        for (item, _, _), b in zip(plans, best):
            scores, null, ids = b.rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), item)), pa.array(ids, mask=null), pa.array(scores)], schema=FOUND)

    return lists.mapInArrow(searched, "item long, doc_id long, score long")
