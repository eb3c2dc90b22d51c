"""Packing of whole documents into as few sequences as possible, by sums of squares."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import stage
from . import encoders
from .columns import named

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECE + ", sequence_id long, offset long"
#: Pieces that one packing task holds, as lengths and checksums.
PIECES = 32_768
#: Sequence ids hold the packing task above this bit.
SHIFT = 32


def cuts(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of a document's pieces: it is whole if it fits; else all pieces but the first are full."""
    first = tokens % capacity or min(tokens, capacity)
    return [(0, first), *((at, at + capacity) for at in range(first, tokens, capacity))]


def sums_of_squares(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of the places of lengths, each placed, in the given order, where the sum over all gaps of the squared number of open bins with that gap becomes smallest.

    A length goes into an open bin with room or into a new one; of equal sums to the smallest gap
    that is left, and into a new bin only if that is strictly better. A full bin is closed and
    counts no more. Only the change of the sum is computed, for all gaps at once.
    """
    count = np.zeros(capacity, dtype=np.int64)  # open bins by gap
    open_: list[list[list[int]]] = [[] for _ in range(capacity)]
    closed: list[list[int]] = []
    never = np.iinfo(np.int64).max
    for at, size in enumerate(lengths.tolist()):
        gap, least = capacity, 2 * count[capacity - size] + 1 if size < capacity else 0
        if size < capacity:
            change = np.where(count[size:] > 0, 2 * (count[: capacity - size] - count[size:] + 1), never)
            if count[size]:
                change[0] = 1 - 2 * count[size]  # closes a bin
            best = int(change.argmin())
            if change[best] <= least:
                gap = best + size
        held = open_[gap].pop() if gap < capacity else []
        if gap < capacity:
            count[gap] -= 1
        held.append(at)
        if gap == size:
            closed.append(held)
        else:
            count[gap - size] += 1
            open_[gap - size].append(held)
    return closed + [b for same in open_ for b in same]


def tightest(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of the places of lengths, each placed, in the given order, into the fullest bin with room."""
    bins: list[list[list[int]]] = [[] for _ in range(capacity + 1)]  # by room
    count = np.zeros(capacity + 1, dtype=np.int64)
    for at, size in enumerate(lengths.tolist()):
        fits = np.flatnonzero(count[size:])
        room = int(fits[0]) + size if len(fits) else capacity
        held = bins[room].pop() if len(fits) else []
        count[room] -= bool(len(fits))
        held.append(at)
        bins[room - size].append(held)
        count[room - size] += 1
    return [b for same in bins for b in same]


def packed(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of the places of lengths, which fall: by sums of squares, in rounds.

    A round's full bins stay; what the others hold is placed again, longest first, by sums of squares,
    as long as that fills a bin. The fewest bins of all rounds count; only if placing what the last round left into the
    tightest takes fewer still, that does.
    """
    full: list[list[int]] = []
    left, best = np.arange(len(lengths)), None
    while len(left):
        bins = [left[b].tolist() for b in sums_of_squares(lengths[left], capacity)]
        if best is None or len(full) + len(bins) < len(best):
            best = full + bins
        filled = [lengths[b].sum() == capacity for b in bins]
        if not any(filled):
            break
        full = full + [b for b, done in zip(bins, filled) if done]
        left = np.array(sorted(i for b, done in zip(bins, filled) if not done for i in b), dtype=np.int64)
    last = full + [left[b].tolist() for b in tightest(lengths[left], capacity)]
    return last if best is None or len(last) < len(best) else best


def pack(df: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id", capacity: int = 2048, end_id: int = 0, pieces: int = PIECES) -> DataFrame:
    """Whole documents in as few sequences of at most ``capacity`` tokens as sums of squares find.

    A document is its token ids and then ``end_id``; a null or empty text is that id alone. Only a
    document of more than ``capacity`` ids is cut: into full pieces, before which the first, shorter
    one stands. Returns PLACED's columns, a row for each piece: piece counts from 0, start counts the
    document's ids before it, ids_crc32 is over its ids as little-endian unsigned 32-bit words, offset
    is its place in its sequence, gapless from 0. Other columns of df don't matter. Repeated rows are
    packed once each; a null doc_id stays null. An empty table gives no rows.

    Texts are tokenized where they are read, and only lengths and checksums move on, written once in
    the shared folder. They are dealt evenly into tasks of at most about ``pieces`` of them; a task
    sorts its own, longest first, by all their columns, so that one that runs again gives the same.
    Memory is bounded by one text's ids in the first pass and by ``pieces`` in the second.
    """
    if capacity < 1 or pieces < 1:
        raise ValueError("capacity and pieces are at least 1")

    def tokenized(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoders.load(tokenizer_path)
        for part in parts:
            rows: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for doc, body in zip(part["doc_id"].to_pylist(), part["text"]):
                body = body.as_py()
                ids = np.append(encoder.encode(body) if body else np.empty(0, np.uint32), np.uint32(end_id)).astype("<u4")
                for number, (begin, end) in enumerate(cuts(len(ids), capacity)):
                    for name, value in zip(rows, (doc, number, begin, end - begin, zlib.crc32(ids[begin:end].tobytes()))):
                        rows[name].append(value)
            yield pa.RecordBatch.from_pydict(rows, _schema(PIECE))

    def placed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts, _schema(PIECE))
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        lengths = table["length"].to_numpy()
        sequence, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
        first = TaskContext.get().partitionId() << SHIFT
        for number, held in enumerate(packed(lengths, capacity)):
            sequence[held] = first + number
            offset[held] = np.cumsum(lengths[held]) - lengths[held]
        yield from table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).to_batches()

    cut = stage(df.select(named(doc_id).cast("long").alias("doc_id"), named(text).alias("text")).mapInArrow(tokenized, PIECE), "pieces")
    return cut.repartition(max(1, -(-cut.count() // pieces))).mapInArrow(placed, PLACED)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def lower_bound(placed: DataFrame, capacity: int = 2048) -> DataFrame:
    """(sequences, tokens, least): how many sequences a packing has, its tokens, and the sequences that these need at least."""
    return placed.agg(F.count_distinct("sequence_id").alias("sequences"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).withColumn("least", F.ceil(F.col("tokens") / capacity))
