"""Phrases of a vocabulary in texts: substrings, and longest matches over tokens."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ..functions.staging import salted, stage
from . import vocabulary_filter

#: Terms, and their characters, up to which a vocabulary goes to the workers as an automaton; a larger one stays distributed: workers get a filter of its bits, and what passes joins it.
TERMS, CHARACTERS = 200_000, 4 << 20
#: Of a vocabulary of at most so many such automatons, totals are added up over them, a pass over the texts for each.
PARTS = 4
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def bounded(vocabulary: DataFrame, term: str, terms: int = TERMS) -> tuple[DataFrame, list[str] | None]:
    """The different lower-cased terms that aren't empty; and as a list, if they are within ``terms`` and CHARACTERS."""
    lowered = stage(vocabulary.select(F.lower(term).alias("term")).filter("term <> ''").distinct(), "terms")
    n, characters = lowered.agg(F.count("*"), F.sum(F.length("term"))).first()
    return lowered, [r["term"] for r in lowered.collect()] if n <= terms and (characters or 0) <= CHARACTERS else None


def substring_matches(df: DataFrame, text: str, key: str, vocabulary: DataFrame, term: str, terms: int = TERMS, known: tuple[DataFrame, list[str] | None] | None = None) -> DataFrame:
    """(key, term, first) of every different term that a text contains, letter case aside; first is the 0-based place of its first match.

    A vocabulary of up to ``terms`` goes to the workers as an automaton, built once in each, which finds
    all terms in one pass over each text. Of a larger one the workers get a filter of bits: rolling
    hashes find the places of a text where a term may stand, in time that grows with its length, and what
    passes is joined with the terms by the string itself; a term that very many texts hold is dealt
    into several tasks. Keys are unique. known is what ``bounded`` gave, where that is there already.
    """
    source = df.select(F.col(key).alias("key"), F.lower(text).alias("text")).filter("text is not null")
    lowered, words = known or bounded(vocabulary, term, terms)
    schema = f"key {source.schema['key'].dataType.simpleString()}, term string, first int"
    if words is None:
        return _filtered(source, lowered, schema)
    found = _firsts(words)

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(k, w, end - len(w) + 1) for k, body in zip(part["key"], part["text"]) for w, end in found(body).items()]
            yield pd.DataFrame(rows, columns=["key", "term", "first"])

    return source.mapInPandas(scan, schema)


def substring_totals(df: DataFrame, text: str, key: str, vocabulary: DataFrame, term: str, terms: int = TERMS) -> DataFrame:
    """(key, terms, places) of each text with a substring match: how many different terms it contains, and the sum of the places of their first matches.

    With an automaton a text is added up where it is read, so no row is made for each of its terms. A
    larger vocabulary is dealt into up to PARTS automatons, each of which goes over the texts; one beyond
    that goes by substring_matches.
    """
    lowered, words = known = bounded(vocabulary, term, terms)
    lists = [words] if words is not None else _parts(lowered, terms)
    if lists is None:
        hits = substring_matches(df, text, key, vocabulary, term, terms, known)
        return hits.groupBy("key").agg(F.count("*").alias("terms"), F.sum("first").alias("places"))
    source = df.select(F.col(key).alias("key"), F.lower(text).alias("text")).filter("text is not null")
    schema = f"key {source.schema['key'].dataType.simpleString()}, terms long, places long"

    def totals(found: Callable[[str], dict[str, int]]) -> DataFrame:
        def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                rows = [(k, len(first), sum(first.values()) + len(first) - sum(map(len, first))) for k, first in zip(part["key"], map(found, part["text"])) if first]
                yield pd.DataFrame(rows, columns=["key", "terms", "places"])

        return source.mapInPandas(scan, schema)

    each = reduce(DataFrame.unionByName, [totals(_firsts(x)) for x in lists])
    return each.groupBy("key").agg(F.sum("terms").alias("terms"), F.sum("places").alias("places"))


def _parts(lowered: DataFrame, terms: int) -> list[list[str]] | None:
    """Different terms dealt by a hash into lists that make an automaton each, of about ``terms`` and CHARACTERS at most; None if they would be more than PARTS."""
    n, characters = lowered.agg(F.count("*"), F.sum(F.length("term"))).first()
    parts = max(-(-n // terms), -(-characters // CHARACTERS))
    if parts > PARTS:
        return None
    return [[r["term"] for r in lowered.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == k).collect()] for k in range(parts)]


def _firsts(words: list[str]) -> Callable[[str], dict[str, int]]:
    """A function from a text to the terms that it contains, each with the place of the last letter of its first match."""
    digest = hashlib.sha256("\0".join(words).encode()).digest()

    def found(body: str) -> dict[str, int]:
        first: dict[str, int] = {}
        if words:
            for end, w in _automaton(digest, words).iter(body):
                if w not in first:  # nearly always it is there
                    first[w] = end
        return first

    return found


_MACHINES: dict[bytes, object] = {}


def _automaton(digest: bytes, words: list[str]):
    """The automaton of a list, kept in the worker process until another list comes."""
    if digest not in _MACHINES:
        import ahocorasick

        _MACHINES.clear()
        machine = ahocorasick.Automaton()
        for w in words:
            machine.add_word(w, w)
        if words:
            machine.make_automaton()
        _MACHINES[digest] = machine
    return _MACHINES[digest]


def _filtered(source: DataFrame, lowered: DataFrame, schema: str) -> DataFrame:
    widths = [r[0] for r in lowered.select(F.length("term").alias("n")).distinct().collect()]  # as many as there are lengths
    held = source.sparkSession.sparkContext.broadcast(vocabulary_filter.build(lowered, vocabulary_filter.letters, widths))

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for k, body in zip(part["key"], part["text"]):
                first: dict[str, int] = {}
                for width, places in held.value.windows(vocabulary_filter.letters(body)):
                    for at in places.tolist():
                        first.setdefault(body[at : at + width], at)
                yield pd.DataFrame([(k, w, at) for w, at in first.items()], columns=["key", "term", "first"], dtype=object)

    return salted(stage(source.mapInPandas(scan, schema), "may"), lowered, ["term"]).select("key", "term", "first")


def substring_join(df: DataFrame, text: str, key: str, vocabulary: DataFrame, term: str, top: int = 50, hits: DataFrame | None = None) -> DataFrame:
    """For each term of the vocabulary the first max(1, top // 5) texts, by key, that contain it; a term without any gets one row whose key is null.

    hits are the substring_matches of all these, where they are there already.
    """
    hits = substring_matches(df, text, key, vocabulary, term) if hits is None else hits
    ranked = hits.withColumn("n", F.row_number().over(W.Window.partitionBy("term").orderBy("key"))).filter(F.col("n") <= max(1, top // 5)).select("term", "key", "n")
    every = vocabulary.select(F.lower(term).alias("term")).distinct()
    return every.join(ranked, "term", "left").select("term", "key", F.coalesce("n", F.lit(0)).alias("n"))


def dictionary_spans(df: DataFrame, key: str, tokens: str, vocabulary: DataFrame, term: str, terms: int = TERMS) -> DataFrame:
    """df's (key, tokens) with spans: leftmost longest matches (start, end exclusive) of blank-separated terms among lower-cased tokens.

    A vocabulary of up to ``terms`` goes to the workers, which walk each text from left to right and
    look up, longest first, the numbers of tokens that terms of that first token have. A larger one
    stays distributed: workers get a filter of its bits, the runs of tokens that pass it are joined with
    the terms, and what fits is then walked in the same way.
    """
    lowered, words = bounded(vocabulary, term, terms)
    if words is None:
        return _spans_by_filter(df.select(key, tokens), tokens, lowered)

    @F.pandas_udf(SPANS)
    def walked(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, heads = {tuple(x.split(" ")) for x in words}, {}
        for w in known:
            heads.setdefault(w[0], set()).add(len(w))
        heads = {h: sorted(n, reverse=True) for h, n in heads.items()}
        for part in parts:
            out = []
            for row in part:
                low, k, spans = [x.lower() for x in row] if row is not None else [], 0, []
                while k < len(low):
                    fit = next((n for n in heads.get(low[k], ()) if k + n <= len(low) and tuple(low[k : k + n]) in known), 0)
                    if fit:
                        spans.append({"start": k, "end": k + fit})
                    k += fit or 1
                out.append(spans)
            yield pd.Series(out)

    return df.withColumn("spans", walked(F.col(tokens)))


@F.pandas_udf(SPANS)
def _from_left(found: pd.Series) -> pd.Series:
    """Spans that don't overlap, taken from left to right, of equal starts the longest."""
    out = []
    for row in found:
        kept, free = [], 0
        for start, end in sorted(((x["start"], x["end"]) for x in row), key=lambda x: (x[0], -x[1])) if row is not None else ():
            if start >= free:
                kept.append({"start": start, "end": end})
                free = end
        out.append(kept)
    return pd.Series(out)


def _token_codes(tokens: list[str]) -> np.ndarray:
    """A number for each token, the same in every process; of one that holds a blank a number that no term's token has."""
    return np.array([int.from_bytes(hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=8).digest(), "little") >> 1 if " " not in x else (1 << 64) - 1 for x in tokens], dtype=np.uint64)


def _spans_by_filter(df: DataFrame, tokens: str, lowered: DataFrame) -> DataFrame:
    rows = stage(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    widths = [r[0] for r in lowered.select(F.size(F.split("term", " ", -1)).alias("n")).distinct().collect()]  # different numbers of tokens in a term
    held = rows.sparkSession.sparkContext.broadcast(vocabulary_filter.build(lowered, lambda x: _token_codes(x.split(" ")), widths))

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row, body in zip(part["_row"], part["low"]):
                low = list(body)
                found = [(row, " ".join(low[at : at + n]), at, at + n) for n, places in held.value.windows(_token_codes(low)) for at in places.tolist()]
                yield pd.DataFrame(found, columns=["_row", "term", "start", "end"], dtype=object)

    low = rows.select("_row", F.transform(tokens, F.lower).alias("low")).filter("low is not null")
    runs = stage(low.mapInPandas(scan, "_row long, term string, start int, end int"), "runs")
    fits = salted(runs, lowered, ["term"]).filter(F.size(F.split("term", " ", -1)) == F.col("end") - F.col("start"))
    spans = fits.groupBy("_row", "start").agg(F.max("end").alias("end"))
    found = spans.groupBy("_row").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    return rows.join(found, "_row", "left").withColumn("spans", _from_left(F.coalesce("found", F.array().cast(SPANS)))).drop("_row", "found")


def bio_tags(tokens: Column, spans: Column) -> Column:
    """O, B-FOT and I-FOT for each token by spans (start, end exclusive) that don't overlap."""
    first = F.transform(spans, lambda s: s["start"])
    inner = F.flatten(F.transform(spans, lambda s: F.filter(F.sequence(s["start"], s["end"] - 1), lambda k: k > s["start"])))
    every = F.transform(tokens, lambda x, i: i)
    # marks of all places: those of the spans, then of what is left
    marks = F.concat(F.transform(first, lambda k: F.struct(k.alias("k"), F.lit("B-FOT").alias("t"))), F.transform(inner, lambda k: F.struct(k.alias("k"), F.lit("I-FOT").alias("t"))), F.transform(F.array_except(every, F.concat(first, inner)), lambda k: F.struct(k.alias("k"), F.lit("O").alias("t"))))
    return F.transform(F.array_sort(marks), lambda m: m["t"])
