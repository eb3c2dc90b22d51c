"""A bit filter of a large vocabulary, and what of a sequence may be in it, by rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits that a term may take in the filter, and bytes that the whole filter may have: beyond them it lets more through, and a join still drops that.
BITS, FILTER_BYTES = 32, 32 << 20
#: Bytes of a segment, the part of a filter that one task call builds; places of a sequence that are hashed at once.
SEGMENT, PIECE = 1 << 16, 1 << 20
#: Odd, so that its powers have inverses among 64-bit numbers.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class Hashes:
    """Hashes of all windows of a sequence of numbers, in one pass for each width.

    The sum of c[i] BASE^i over a window, times BASE^-start, is the same wherever the window stands; sums
    of windows are differences of sums from the start. Numbers wrap at 64 bits.
    """

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        with np.errstate(over="ignore"):
            powers, self.inverse = _powers(n)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes.astype(np.uint64) * powers)])

    def windows(self, width: int, at: np.ndarray | None = None) -> np.ndarray:
        """The hash of the window of a width at every place, or at some."""
        with np.errstate(over="ignore"):
            if at is None:
                n = max(0, len(self.sums) - width)
                return mixed((self.sums[width:] - self.sums[:n]) * self.inverse[:n], width)
            return mixed((self.sums[at + width] - self.sums[at]) * self.inverse[at], width)


_TABLE = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse; tables that grow by doubling."""
    while len(_TABLE[0]) < n + 1:
        k = len(_TABLE[0])
        for j, root in enumerate((int(BASE), pow(int(BASE), -1, 1 << 64))):
            _TABLE[j] = np.concatenate([_TABLE[j], _TABLE[j] * np.uint64(pow(root, k, 1 << 64))])
    return _TABLE[0][:n], _TABLE[1][: n + 1]


def mixed(h: np.ndarray, width: int) -> np.ndarray:
    """h spread over all 64 bits, in its own way for each width."""
    h = h + np.uint64(width * 0xD1342543DE82EF95 & (1 << 64) - 1)
    for m in _MIX:
        h = (h ^ (h >> np.uint64(30))) * m
    return h ^ (h >> np.uint64(31))


def letters(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")


def head(width: int) -> int:
    """The largest power of two that isn't above a width: of so many numbers a term's head consists."""
    return 1 << (width.bit_length() - 1)


class Filter:
    """Bits of the heads and of the whole of each term; what isn't in a vocabulary passes seldom, what is in it always."""

    def __init__(self, bits: np.ndarray, widths: list[int]):
        self.bits, self.places = bits, np.uint64(len(bits) * 8 - 1)
        self.classes: dict[int, list[int]] = {}
        for w in sorted(widths):
            self.classes.setdefault(head(w), []).append(w)

    def has(self, h: np.ndarray) -> np.ndarray:
        return ((self.bits[(h & self.places) >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)

    def windows(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(width, places) of the windows of a sequence that may be terms, places ascending for each width; a long sequence comes in pieces that overlap by the longest term."""
        longest = max((widths[-1] for widths in self.classes.values()), default=1)
        for start in range(0, len(codes), PIECE):
            for width, at in self._of_piece(codes[start : start + PIECE + longest - 1]):
                at = at[at < PIECE]
                if len(at):
                    yield width, at + start

    def _of_piece(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """A pass for each class of heads, then only where a head was met for each width of the class."""
        hashes, n = Hashes(codes), len(codes)
        for first, widths in self.classes.items():
            if first <= n:
                met = np.flatnonzero(self.has(hashes.windows(first)))
                for w in widths:
                    at = met[met + w <= n]
                    yield w, at if w == first else at[self.has(hashes.windows(w, at))]


def term_bits(terms: list[np.ndarray]) -> list[list[int]]:
    """For each term the hashes of its head and of the whole, as signed numbers; terms of one length at once."""
    out: list[list[int]] = [[] for _ in terms]
    lengths = np.array([len(t) for t in terms])
    for n in set(lengths.tolist()):
        at = np.flatnonzero(lengths == n)
        with np.errstate(over="ignore"):
            sums = np.cumsum(np.stack([terms[k] for k in at]).astype(np.uint64) * _powers(n)[0], axis=1)
        for w in {head(n), n}:
            for k, h in zip(at.tolist(), mixed(sums[:, w - 1], w).astype(np.int64).tolist()):
                out[k].append(h)
    return out


def build(terms: DataFrame, codes, widths: list[int]) -> Filter:
    """The filter of a table with a column term, none of them empty; codes(term) gives a term's numbers.

    Hashes go by their segment to the tasks that set its bits; the driver gets the segments, which are
    at most FILTER_BYTES together however large the vocabulary is.
    """
    n = terms.count()
    size = SEGMENT
    while size * 8 < n * BITS and size < FILTER_BYTES:
        size *= 2

    @F.pandas_udf("array<long>")
    def hashed(part: pd.Series) -> pd.Series:
        return pd.Series(term_bits([codes(x) for x in part]))

    def segment(part: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(SEGMENT, dtype=np.uint8)
        at = part["h"].to_numpy().astype(np.uint64) & np.uint64(SEGMENT * 8 - 1)
        np.bitwise_or.at(out, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
        return pd.DataFrame({"segment": [part["segment"].iloc[0]], "bits": [out.tobytes()]})

    each = terms.select(F.explode(hashed("term")).alias("h")).distinct()
    number = F.shiftright(F.col("h").bitwiseAND(size * 8 - 1), (SEGMENT * 8).bit_length() - 1).cast("int")
    bits = np.zeros(size, dtype=np.uint8)
    for r in each.withColumn("segment", number).groupBy("segment").applyInPandas(segment, "segment int, bits binary").collect():
        bits[r["segment"] * SEGMENT : (r["segment"] + 1) * SEGMENT] = np.frombuffer(r["bits"], dtype=np.uint8)
    return Filter(bits, widths)
