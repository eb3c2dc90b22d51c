"""A part-of-speech tagger learned by counting: words and tag pairs, suffixes for unknown words, decoding of whole sentences."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.staging import small, stage
from .tagging import best_paths

#: Letters of the longest suffix; words seen at most so often count for suffixes, as unknown words are rare ones.
SUFFIX, RARE = 4, 10
#: The weight of the tags' own shares among a word's tags, and among a suffix's.
WORD_EXTRA, SUFFIX_EXTRA = 0.01, 1.0
#: Tokens of the rows that are tagged in one task call, but for the last row's.
CHUNK_TOKENS = 1 << 20


@dataclass
class Tagger:
    """Tags in order, the logarithms of their transitions, beginnings and ends, and tables of words and of suffixes with a score for each tag."""

    tags: list[str]
    transitions: np.ndarray
    start: np.ndarray
    end: np.ndarray
    words: DataFrame
    suffixes: DataFrame


def suffixes(word: Column) -> Column:
    """The endings of a word, the longest first, each shorter than five letters."""
    lengths = F.filter(F.array(*(F.lit(n) for n in range(SUFFIX, 0, -1))), lambda n: n <= F.length(word))
    return F.transform(lengths, lambda n: F.right(word, n))


def _by_tag(counts: DataFrame, key: str, tags: list[str], shares: np.ndarray, extra: float) -> DataFrame:
    """(key, scores): for each tag, in order, the logarithm of its share of the key's counts, smoothed by ``extra``, over its share of all: by Bayes' rule the key's weight under the tag, but for a factor of the key."""
    held = counts.groupBy(key).agg(*(F.sum(F.when(F.col("tag") == t, F.col("n")).otherwise(0)).alias(f"n{k}") for k, t in enumerate(tags)), F.sum("n").alias("all"))
    return held.select(key, F.array(*(F.log((F.col(f"n{k}") + F.lit(extra * share)) / (F.col("all") + extra) / F.lit(float(share))) for k, share in enumerate(shares))).alias("scores"))


def fit(df: DataFrame, tokens: str, tags: str) -> Tagger:
    """A tagger from sentences (arrays of tokens and of as many tags). All counts are aggregates; the driver gets the tags and their pairs only."""
    rows = df.select(F.arrays_zip(F.col(tokens).alias("word"), F.col(tags).alias("tag")).alias("z")).filter("size(z) > 0")
    each = stage(rows.select(F.explode("z").alias("z")).select(F.coalesce("z.word", F.lit("")).alias("word"), "z.tag").filter("tag is not null").groupBy("word", "tag").agg(F.count("*").alias("n")), "words")
    totals = {r["tag"]: r["n"] for r in each.groupBy("tag").agg(F.sum("n").alias("n")).collect()}
    names = sorted(totals)
    if not names:
        raise ValueError("no tagged word")
    shares = np.array([totals[t] for t in names]) / sum(totals.values())
    words = _by_tag(each, "word", names, shares, WORD_EXTRA)
    rare = each.join(each.groupBy("word").agg(F.sum("n").alias("all")).filter(F.col("all") <= RARE).select("word"), "word", "left_semi")
    endings = rare.select(F.explode(suffixes(F.col("word"))).alias("suffix"), "tag", "n").groupBy("suffix", "tag").agg(F.sum("n").alias("n"))
    ends = _by_tag(endings, "suffix", names, shares, SUFFIX_EXTRA)
    # pairs of neighbours, the sentence's edges as an empty tag
    path = rows.select(F.concat(F.array(F.lit("")), F.transform("z", lambda z: z["tag"]), F.array(F.lit(""))).alias("p"))
    pairs = path.select(F.explode(F.arrays_zip(F.slice("p", F.lit(1), F.size("p") - 1).alias("a"), F.slice("p", F.lit(2), F.size("p") - 1).alias("b"))).alias("x")).groupBy("x.a", "x.b").count().collect()
    count = {(r["a"], r["b"]): r["count"] for r in pairs}
    edge = ["", *names]
    table = np.array([[count.get((a, b), 0) + 1.0 for b in edge] for a in edge])
    table = np.log(table / table.sum(axis=1, keepdims=True))
    return Tagger(names, table[1:, 1:], table[0, 1:], table[1:, 0], stage(words, "words"), stage(ends, "suffixes"))


def tag(df: DataFrame, tagger: Tagger, tokens: str, out: str = "tags") -> DataFrame:
    """df with the best sequence of tags of each array of tokens, a column of df; null for null.

    Rows go in chunks of about CHUNK_TOKENS tokens. Each chunk asks for its different words, each
    different word of all is scored once: as it was seen, else by its longest known suffix, else alike
    for all tags. Scores go back to the chunks, not to tokens, and meet the rows there, where a sentence is
    decoded as a whole. So rows are shuffled once, and words once for each chunk that holds them.
    """
    given = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    rows = stage(given.mapInArrow(_dealer(tokens), T.StructType([T.StructField("row", given.schema["row"].dataType), T.StructField("chunk", T.LongType())])), "rows")
    asked = stage(rows.select("chunk", F.col("row").getField(tokens).alias("tokens")).mapInArrow(_different, "chunk long, word string"), "asked")
    words = stage(asked.select("word").distinct(), "words")
    known = words.join(tagger.words, "word").select("word", "scores")
    other = words.join(tagger.words, "word", "left_anti")
    ends = other.select("word", F.explode(suffixes(F.col("word"))).alias("suffix")).join(tagger.suffixes, "suffix").groupBy("word").agg(F.max_by("scores", F.length("suffix")).alias("scores"))
    alike = F.array(*(F.lit(0.0) for _ in tagger.tags))
    scored = stage(reduce(DataFrame.unionByName, [known, other.select("word").join(ends, "word", "left").select("word", F.coalesce("scores", alike).alias("scores"))]), "scored")
    met = asked.join(small(scored), "word").select("chunk", "word", "scores")
    walk, names = best_paths(tagger.transitions, tagger.start, tagger.end), tagger.tags

    def decode(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.column("row").combine_chunks()
        lists = row.field(tokens)
        scores = right.column("scores").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(names))
        at = pc.index_in(pc.fill_null(lists.flatten(), ""), value_set=right.column("word").combine_chunks()).to_numpy(zero_copy_only=False)
        ends = np.cumsum(_lengths(lists))
        paths = walk([scores[x] for x in np.split(at, ends[:-1])])
        told = pa.array(names, pa.string()).take(pa.array(np.concatenate(paths).astype(np.int32)))
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        return pa.table({"row": row, "told": pa.ListArray.from_arrays(offsets, told, mask=lists.is_null())})

    both = T.StructType([rows.schema["row"], T.StructField("told", T.ArrayType(T.StringType()))])
    decoded = rows.groupBy("chunk").cogroup(met.groupBy("chunk")).applyInArrow(decode, both)
    return decoded.select(*(F.col("row").getField(c).alias(c) for c in df.columns if c != out), F.col("told").alias(out))


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _dealer(tokens: str):
    """A function that numbers rows (a struct) by chunks of CHUNK_TOKENS of their tokens, in the order in which they come."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            if batch.num_rows:
                ends = held + np.cumsum(_lengths(batch.column(0).field(tokens)) + 1)
                chunk = first + np.concatenate([[held], ends[:-1]]) // CHUNK_TOKENS
                held = int(ends[-1])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chunk, pa.int64())], ["row", "chunk"])

    return deal


def _different(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, word) of the different words of each run of rows of one chunk, a null as the empty word."""
    own, seen = None, []

    def whole() -> pa.RecordBatch:
        words = pc.unique(pa.concat_arrays(seen))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(words), own), pa.int64()), words], ["chunk", "word"])

    for batch in batches:
        chunk = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                if seen and chunk[a] != own:
                    yield whole()
                    seen = []
                own = chunk[a]
                seen.append(pc.unique(pc.fill_null(batch.column(1).slice(a, b - a).flatten(), "")))
    if seen:
        yield whole()
