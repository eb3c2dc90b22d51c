"""Tagged token sequences: spans of tags, single-entity tags, quality of a tagging, decoding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Weights of part-of-speech tags.
POS_WEIGHTS = {"NOUN": 1.3, "PROPN": 1.3, "ADJ": 1.1, "VERB": 0.9, "NUM": 0.8}


def bio_spans(df: DataFrame, key: str, tags: str) -> DataFrame:
    """(key, start, end) of each run that begins with B and goes on with I; end inclusive. An I without a run before it belongs to none."""
    each = df.select(key, F.posexplode(tags).alias("pos", "tag"))
    ordered = W.Window.partitionBy(key).orderBy("pos")
    runs = each.withColumn("run", F.count_if(F.col("tag").isin("B-FOT", "O")).over(ordered))
    return runs.filter("tag <> 'O'").groupBy(key, "run").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.max(F.col("tag") == "B-FOT").alias("begun")).filter("begun").select(key, "start", "end")


def single_entity_tags(df: DataFrame, tokens: str, entity: str, out: str, prefix: bool = False) -> DataFrame:
    """df with tags of the first window of tokens equal to an entity's blank-separated ones, letter case aside; with prefix, of the first token from where the joined rest starts with it.

    Tokens hold no blanks, so the place is sought in the joined text and counted in blanks before it.
    """
    joined = F.lower(F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")))
    wanted = F.concat(F.lit(" "), F.lower(entity), F.lit("" if prefix else " "))
    found = df.withColumn("_at", F.instr(joined, wanted)).withColumn("_before", F.left(joined, F.col("_at") - 1))
    found = found.withColumn("_at", F.when(F.col("_at") == 0, -1).otherwise(F.length("_before") - F.length(F.replace("_before", F.lit(" "), F.lit("")))))
    # arrays are put together, not mapped: a lambda would compute the place again for each token
    at, n, length = F.coalesce("_at", F.lit(-1)), F.size(tokens), F.size(F.split(entity, " "))
    tagged = F.concat(F.array_repeat(F.lit("O"), at), F.array(F.lit("B-FOT")), F.array_repeat(F.lit("I-FOT"), length - 1), F.array_repeat(F.lit("O"), n - at - length))
    return found.withColumn(out, F.when(F.col(tokens).isNotNull(), F.when(at < 0, F.array_repeat(F.lit("O"), n)).otherwise(tagged))).drop("_at", "_before")


def tag_penalty(df: DataFrame, key: str, tags: str, pos: str) -> DataFrame:
    """(key, penalty): what a sequence's tags cost by these rules over neighbours, lower is better.

    0.5 for a B not followed by I; 1.0 for an I after neither B nor I; 0.8 for a tag on ADP, DET or
    PRON; 1.0 for an I not right after B; 0.8 for a tag followed by none; 1.0 for a sequence without tags.
    """
    each = df.select(key, F.posexplode(F.arrays_zip(F.col(tags).alias("t"), F.col(pos).alias("p"))).alias("i", "z")).select(key, "i", "z.t", "z.p")
    w = W.Window.partitionBy(key).orderBy("i")
    rows = each.withColumn("before", F.lag("t").over(w)).withColumn("after", F.lead("t").over(w))
    tagged, inner = F.col("t") != "O", F.col("before").isNotNull()
    cost = (
        F.when(inner & (F.col("before") == "B-FOT") & (F.col("t") != "I-FOT"), 0.5).otherwise(0.0)
        + F.when(inner & (F.col("t") == "I-FOT") & (F.col("before") == "O"), 1.0).otherwise(0.0)
        + F.when(inner & tagged & F.col("p").isin("ADP", "DET", "PRON"), 0.8).otherwise(0.0)
        + F.when(inner & (F.col("t") == "I-FOT") & (F.col("before") != "B-FOT"), 1.0).otherwise(0.0)
        + F.when(inner & tagged & (F.col("after") == "O"), 0.8).otherwise(0.0)
    )
    return rows.groupBy(key).agg((F.sum(cost) + F.when(F.count_if(tagged) == 0, 1.0).otherwise(0.0)).alias("penalty"))


def adjusted_weight(f1: Column, weight: Column, least: float = 0.5, most: float = 2.0) -> Column:
    """A tenth up to most below an F1 of 0.5, a tenth down to least above 0.8."""
    return F.when(f1 < 0.5, F.least(weight * 1.1, F.lit(most))).when(f1 > 0.8, F.greatest(weight * 0.9, F.lit(least))).otherwise(weight)


def run_lengths(df: DataFrame, key: str, tags: str) -> DataFrame:
    """One row, mean_run: the mean length of the tagged runs within sequences."""
    return bio_spans(df, key, tags).agg(F.avg((F.col("end") - F.col("start") + 1).cast("double")).alias("mean_run"))


def viterbi(transitions: np.ndarray, start: np.ndarray, end: np.ndarray):
    """An Arrow function from emissions (array of arrays) to the best tag numbers; ties go to the smaller tag. Sequences of a batch are walked together; an empty or null one has none."""

    walk = best_paths(transitions, start, end)

    @F.pandas_udf("array<int>")
    def decode(sequences: pd.Series) -> pd.Series:
        return pd.Series(walk([_matrix_of(x) for x in sequences]))

    return decode


def best_paths(transitions: np.ndarray, start: np.ndarray, end: np.ndarray) -> Callable[[list[np.ndarray]], list[list[int]]]:
    """What ``viterbi`` does, from matrices of emissions to lists of tag numbers."""

    def walk(each: list[np.ndarray]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in each]
        for own, e, lengths in _together(each):
            # shorter ones come first, so at each place those that go on are the last rows
            longest = e.shape[1]
            begin = np.searchsorted(lengths, np.arange(longest), side="right")
            final = start + e[:, 0]
            back = np.zeros(e.shape, dtype=np.int32)
            for t in range(1, longest):
                every = final[begin[t] :, :, None] + transitions
                back[begin[t] :, t] = every.argmax(axis=1)
                final[begin[t] :] = every.max(axis=1) + e[begin[t] :, t]
            at, path = (final + end).argmax(axis=1), np.zeros(e.shape[:2], dtype=np.int32)
            for t in range(longest - 1, -1, -1):
                live = at[begin[t] :]
                path[begin[t] :, t] = live
                if t:
                    at[begin[t] :] = back[np.arange(begin[t], len(at)), t, live]
            for row, k in enumerate(own):
                out[k] = path[row, : lengths[row]].tolist()
        return out

    return walk


#: Places of sequences that are padded to one length and walked together.
PLACES = 1 << 18


def _together(sequences: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(indexes, emissions, lengths) of sequences of similar length, padded to the longest of them; empty ones aside."""
    order = sorted((k for k, e in enumerate(sequences) if len(e)), key=lambda k: len(sequences[k]))
    while order:
        longest = len(sequences[order[-1]])
        n = max(1, min(len(order), PLACES // longest))
        own = order[-n:]
        order = order[:-n]
        e = np.zeros((n, longest, sequences[own[0]].shape[1]))
        for row, k in enumerate(own):
            e[row, : len(sequences[k])] = sequences[k]
        yield own, e, np.array([len(sequences[k]) for k in own])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    """The logarithm of the sum of exponentials along an axis; minus infinity where all are."""
    most = x.max(axis=axis, keepdims=True)
    most = np.where(np.isfinite(most), most, 0.0)
    with np.errstate(divide="ignore"):
        return (np.log(np.exp(x - most).sum(axis=axis, keepdims=True)) + most).squeeze(axis)


def _matrix_of(emissions) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=float) for x in emissions]) if emissions is not None and len(emissions) else np.zeros((0, 1))


def forward_backward(transitions: np.ndarray, start: np.ndarray, end: np.ndarray):
    """An Arrow function from emissions (array of arrays) to a struct: log_partition, the logarithm of the summed weights of all taggings, and marginals, each tag's probability at each place.

    Sequences of a batch are walked together, forward and backward, in logarithms. An empty or null
    sequence has the partition 0 and no marginals.
    """

    @F.pandas_udf("log_partition double, marginals array<array<double>>")
    def run(emissions: pd.Series) -> pd.DataFrame:
        sequences = [_matrix_of(x) for x in emissions]
        total, marginals = np.zeros(len(sequences)), [[] for _ in sequences]
        for own, e, lengths in _together(sequences):
            n, longest, tags = e.shape
            forward, backward = np.empty_like(e), np.empty_like(e)
            forward[:, 0] = start + e[:, 0]
            for t in range(1, longest):
                forward[:, t] = _log_sum(forward[:, t - 1, :, None] + transitions, 1) + e[:, t]
            for t in range(longest - 1, -1, -1):
                last = (lengths == t + 1)[:, None]
                after = _log_sum(transitions + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2) if t + 1 < longest else np.zeros((n, tags))
                backward[:, t] = np.where(last, end, after)
            z = _log_sum(start + e[:, 0] + backward[:, 0], 1)
            total[own] = z
            chance = np.exp(forward + backward - z[:, None, None])
            for row, k in enumerate(own):
                marginals[k] = chance[row, : lengths[row]].tolist()
        return pd.DataFrame({"log_partition": total, "marginals": marginals})

    return run


def path_score(transitions: np.ndarray, start: np.ndarray, end: np.ndarray):
    """An Arrow function from emissions and tag numbers to the logarithm of that tagging's weight; with log_partition it gives its probability. Null for an empty or null sequence, or one of another length than its tags."""

    @F.pandas_udf("double")
    def run(emissions: pd.Series, tags: pd.Series) -> pd.Series:
        out = []
        for x, path in zip(emissions, tags):
            e, path = _matrix_of(x), np.asarray([] if path is None else path, dtype=int)
            fits = len(e) and len(e) == len(path)
            out.append(start[path[0]] + e[np.arange(len(e)), path].sum() + transitions[path[:-1], path[1:]].sum() + end[path[-1]] if fits else None)
        return pd.Series(out, dtype=object)

    return run
