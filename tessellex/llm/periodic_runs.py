"""Runs of words that repeat with a period, and texts with one period of each run."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import apart, named, together

RUNS = "array<struct<start: long, length: long, period: long>>"
#: Words that a run has at least.
LEAST = 12
#: Places in which an island of matches is looked for, at most, before it is read word for word.
PROBES = 16


def codes(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    return pd.factorize(np.array(words, dtype=object))[0] if words else np.empty(0, np.int64)


def lag_counts(w: np.ndarray, longest: int) -> np.ndarray:
    """How many places i have w[i] == w[i + lag], for each lag up to ``longest``; that of 0 is left at 0.

    Words of many places add the autocorrelation of their indicator, by a fast Fourier transform whose
    results are rounded to the whole numbers they are; all other words add the differences of their
    places, pair by pair. The bound between them balances the two.
    """
    n, out = len(w), np.zeros(longest + 1, dtype=np.int64)
    order = np.argsort(w, kind="stable")
    sizes = np.bincount(w)
    heavy = np.flatnonzero(sizes > max(8, isqrt(n * n.bit_length()) // 3))
    if len(heavy):
        size = 1 << (n + longest).bit_length()
        power = np.zeros(size // 2 + 1)
        begins = np.cumsum(sizes) - sizes
        for word in heavy:
            x = np.zeros(size)
            x[order[begins[word] : begins[word] + sizes[word]]] = 1.0
            f = np.fft.rfft(x)
            power += f.real**2 + f.imag**2
        out += np.rint(np.fft.irfft(power, size)[: longest + 1]).astype(np.int64)
    light = order[(sizes <= sizes[heavy].min() - 1)[w[order]]] if len(heavy) else order
    if len(light) > 1:
        word, at = w[light], np.arange(len(light) - 1)
        k = 1
        while len(at):  # the k-th next place of the same word
            at = at[word[at] == word[at + k]]
            gaps = light[at + k] - light[at]
            out += np.bincount(gaps[gaps <= longest], minlength=longest + 1)
            k += 1
            at = at[at + k < len(light)]
    out[0] = 0
    return out


def stretches(hits: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hits, [False]]).view(np.int8)))
    return zip(edges[::2].tolist(), edges[1::2].tolist())


def islands(w: np.ndarray, lag: int, least: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the longest stretches of ``least`` or more places i with w[i] == w[i + lag].

    Such a stretch holds least // step places that are multiples of a step, one after the other; only
    around so many matches among these is every place read.
    """
    a, b = w[: len(w) - lag], w[lag:]
    step = max(1, least // PROBES)
    for first, last in stretches(a[::step] == b[::step]):
        if last - first >= least // step:
            low, high = max(0, (first - 1) * step + 1), min(len(a), last * step)
            for start, end in stretches(a[low:high] == b[low:high]) if step > 1 else [(0, high - low)]:
                if end - start >= least:
                    yield low + start, low + end


def runs(w: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of small whole numbers, by start, then period.

    A run is a stretch whose smallest period goes into it twice or more, of ``least`` or more words,
    that no neighbour extends. A run of period p has length - p matches at lag p, so only lags with
    as many are read, the smallest first. At each multiple of its period a run also has matches;
    these are taken off the counts, so that a text of one long loop isn't read at every multiple.
    """
    n = len(w)
    if n < max(least, 2):
        return []
    wanted = np.maximum(least - np.arange(n // 2 + 1), np.arange(n // 2 + 1))
    left = lag_counts(w, n // 2)
    out: dict[tuple[int, int], int] = {}
    for lag in range(1, n // 2 + 1) if (left >= wanted).any() else ():
        if left[lag] < wanted[lag]:
            continue
        for start, end in islands(w, lag, int(wanted[lag])):
            length = end - start + lag
            if (start, length) in out:  # the run of a divisor of this lag
                continue
            out[start, length] = lag
            multiples = np.arange(2 * lag, min(length, n // 2 + 1), lag)
            left[multiples] -= length - multiples
    return sorted((start, length, period) for (start, length), period in out.items())


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay where every run keeps its first period only."""
    edges = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) == 0


def find(df: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """df with n_words, runs (RUNS, by start, then period; see ``runs``) and collapsed: the words without those that a run holds after its first period, joined by single blanks.

    Words are what ASCII white space parts, numbered from 0. A null or empty text, and one without a
    word, has no words, no runs and an empty collapsed. Columns of df named like the three results,
    in any case of letters, are replaced by them; all others stay. Rows repeat as they do in df.

    Each text is whole in one worker, in memory that grows with its words: two transforms of up to
    four times their number, and no table of pairs. All lags up to half the words are counted.
    """

    @F.pandas_udf(f"n long, runs {RUNS}, collapsed string")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for body in part:
                words = body.encode("utf-8", "replace").split() if body else []
                own = runs(codes(words), least)
                rest = words if not own else [words[i] for i in np.flatnonzero(kept(len(words), own))]
                rows.append((len(words), [{"start": s, "length": n, "period": p} for s, n, p in own], b" ".join(rest).decode()))
            yield pd.DataFrame(rows, columns=["n", "runs", "collapsed"])

    held = apart(df, "n_words", "runs", "collapsed", text=named(text)).withColumn("f", found("text"))
    return together(held, n_words=F.col("f.n"), runs=F.col("f.runs"), collapsed=F.col("f.collapsed"))


@F.pandas_udf(T.StringType())
def looped(text: pd.Series, h: pd.Series) -> pd.Series:
    """Words joined by blanks; where h % 10 = 0 those from some place on repeat those that stand there, the places following from h alone. A null h leaves the words as they are."""
    out = []
    for body, number in zip(text, h):
        words = body.encode("utf-8", "replace").split() if body else []
        if words and number == number and number is not None and int(number) % 10 == 0:
            g, n = int(number) // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + k % p] for k in range(n - a)]
        out.append(b" ".join(words).decode())
    return pd.Series(out, dtype=object)
