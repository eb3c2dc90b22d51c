"""Packing of tokenized documents into training sequences with bounded memory."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import stage
from . import encoders
from .columns import named

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequence ids hold the partition above this bit; those of merged leftovers begin at LEFTOVER partitions.
SHIFT, LEFTOVER = 32, 1 << 30
#: Leftover windows that one merging task takes.
MERGED = 256


class Packer:
    """A fixed number of open windows; pieces go where they fit best.

    A piece is (doc_id, start, doc_tokens, ids). When no open window has room, the fullest one is
    topped up with the head of the piece and emitted, and the rest is placed again, so that a window
    that leaves here is full.
    """

    def __init__(self, capacity: int, open_windows: int, partition: int):
        self.capacity, self.most, self.next_id = capacity, open_windows, partition << SHIFT
        self.windows: list[list[tuple]] = []
        self.rooms: list[tuple[int, int]] = []  # (room, index in windows), ascending
        self.free: list[int] = []

    def emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset, sequence = 0, self.next_id
        self.next_id += 1
        for doc, start, tokens, ids in pieces:
            yield doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, sequence, offset
            offset += len(ids)

    def add(self, doc, start: int, tokens: int, ids: np.ndarray) -> Iterator[tuple]:
        while len(ids) >= self.capacity:
            yield from self.emit([(doc, start, tokens, ids[: self.capacity])])
            ids, start = ids[self.capacity :], start + self.capacity
        while len(ids):
            k = bisect_left(self.rooms, (len(ids), -1))
            if k < len(self.rooms):
                room, w = self.rooms.pop(k)
            elif len(self.windows) - len(self.free) < self.most:
                room, w = self.capacity, self.free.pop() if self.free else len(self.windows)
                if w == len(self.windows):
                    self.windows.append([])
            else:
                room, w = self.rooms.pop(0)
            head = ids[:room]
            self.windows[w].append((doc, start, tokens, head.copy()))
            ids, start, room = ids[len(head) :], start + len(head), room - len(head)
            if room:
                insort(self.rooms, (room, w))
            else:
                yield from self.emit(self.windows[w])
                self.windows[w] = []
                self.free.append(w)

    def merged(self) -> tuple[list[tuple], list[tuple]]:
        """What merging the open windows, fullest first, emits as full sequences; and the pieces of the last, partial one."""
        out, held, used = [], [], 0
        for _, w in self.rooms:
            for doc, start, tokens, ids in self.windows[w]:
                while len(ids):
                    head = ids[: self.capacity - used]
                    held.append((doc, start, tokens, head))
                    ids, start, used = ids[len(head) :], start + len(head), used + len(head)
                    if used == self.capacity:
                        out += self.emit(held)
                        held, used = [], 0
        return out, held

    def closed(self, held: list[tuple]) -> list[tuple]:
        """The last, partial sequence as sequences whose lengths are powers of two, largest first: they need no padding."""
        out, used, left = [], 0, sum(len(p[3]) for p in held)
        part, size = [], 1 << (left.bit_length() - 1) if left else 0
        for doc, start, tokens, ids in held:
            while len(ids):
                head = ids[: size - used]
                part.append((doc, start, tokens, head))
                ids, start, used = ids[len(head) :], start + len(head), used + len(head)
                if used == size:
                    out += self.emit(part)
                    left -= size
                    part, used, size = [], 0, 1 << (left.bit_length() - 1) if left else 0
        return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    frame = pd.DataFrame(rows, columns=columns)
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    return frame


def pack(df: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id", capacity: int = 1024, open_windows: int = 32, end_id: int = 0) -> DataFrame:
    """The pieces of all documents in sequences of at most ``capacity`` tokens.

    A document is its token ids and then ``end_id``; a null or empty text is that id alone. Each id
    lies in exactly one piece. Returns PIECE's columns: start counts the document's ids before the
    piece, ids_crc32 is over its ids as little-endian unsigned 32-bit words, doc_tokens has the
    document's length with the end id, and offset is the piece's place in its sequence, gapless from
    0. Other columns of df don't matter. Repeated rows are packed once each; a null doc_id stays null.
    An empty table gives no rows.

    Each input partition packs its documents as they come with ``open_windows`` windows. What stays
    open at its end is merged to less than one window; these leftovers, of all partitions, are
    merged again by the same packer, MERGED windows to a task, and a task's last partial sequence
    ends as sequences of power-of-two lengths. So memory is bounded, and no sequence needs padding.
    Pieces are written once in the shared folder.
    """
    if capacity < 1 or open_windows < 1:
        raise ValueError("capacity and open_windows are at least 1")

    def first(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoders.load(tokenizer_path)
        packer = Packer(capacity, open_windows, TaskContext.get().partitionId())
        rows: list[tuple] = []
        for part in parts:
            for doc, body in zip(part["doc_id"], part["text"]):
                ids = np.append(encoder.encode(body) if body else np.empty(0, np.uint32), np.uint32(end_id))
                rows += [(*r, None) for r in packer.add(None if doc is None else int(doc), 0, len(ids), ids)]
                if len(rows) >= 20_000:
                    yield _frame(rows)
                    rows = []
        full, held = packer.merged()
        rows += [(*r, None) for r in full]
        rows += [(doc, start, len(ids), 0, tokens, packer.next_id, 0, ids.astype("<u4").tobytes()) for doc, start, tokens, ids in held]
        yield _frame(rows)

    def second(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(capacity, open_windows, LEFTOVER + TaskContext.get().partitionId())
        for part in parts:
            rows: list[tuple] = []
            for doc, start, tokens, ids in zip(part["doc_id"], part["start"], part["doc_tokens"], part["ids"]):
                rows += packer.add(None if doc is None else int(doc), int(start), int(tokens), np.frombuffer(ids, "<u4"))
            yield _frame([(*r, None) for r in rows]).drop(columns="ids")
        full, held = packer.merged()
        yield _frame([(*r, None) for r in full + packer.closed(held)]).drop(columns="ids")

    # ids go to Python as text: Arrow's nulls would make them floats
    source = df.select(named(doc_id).cast("long").cast("string").alias("doc_id"), named(text).alias("text"))
    placed = stage(source.mapInPandas(first, PIECE + ", ids binary"), "pieces")
    open_ = placed.filter(F.col("ids").isNotNull())
    windows = open_.agg(F.count_distinct("sequence_id")).first()[0]
    rest = open_.withColumn("doc_id", F.col("doc_id").cast("string")).repartition(max(1, -(-windows // MERGED))).mapInPandas(second, PIECE)
    return placed.filter(F.col("ids").isNull()).drop("ids").unionByName(rest)
