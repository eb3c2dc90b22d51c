"""Evaluation: counts to rates, ranks to recall, agreement of tags and spans."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ..functions.arrays import scaled


def rates(hit: Column, predicted: Column, gold: Column) -> list[Column]:
    """precision, recall and f1 of counts, 0 where a count is 0."""
    p, r = F.coalesce(F.try_divide(hit, predicted), F.lit(0.0)), F.coalesce(F.try_divide(hit, gold), F.lit(0.0))
    return [p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1")]


def binary_rates(df: DataFrame, gold: str, predicted: str, skip: int | None = None) -> DataFrame:
    """One row with tp, predicted, gold and their rates for the label 1; predictions equal to skip count nowhere."""
    own = df.filter(F.col(predicted) != skip) if skip is not None else df
    counts = own.agg(F.count_if((F.col(gold) == 1) & (F.col(predicted) == 1)).alias("tp"), F.count_if(F.col(predicted) == 1).alias("predicted"), F.count_if(F.col(gold) == 1).alias("gold"))
    return counts.select("tp", "predicted", "gold", *rates(F.col("tp"), F.col("predicted"), F.col("gold")))


def confusion(df: DataFrame, gold: str, predicted: str, labels: list) -> DataFrame:
    """(gold, then a column p_<label> for each label): how often each label was predicted."""
    return df.groupBy(F.col(gold).alias("gold")).agg(*(F.count_if(F.col(predicted) == x).alias(f"p_{x}") for x in labels))


def recall_at(df: DataFrame, rank: str, ks: list[int], by: str | None = None) -> DataFrame:
    """(by, k, recall): the share of rows whose 1-based rank is at most k (0 or null: not found), for each group and, with a null group, for all."""
    hits = [F.struct(F.lit(k).alias("k"), F.avg(F.when((F.col(rank) >= 1) & (F.col(rank) <= k), 1.0).otherwise(0.0)).alias("recall")) for k in ks]
    grouped = df.rollup(by) if by else df.groupBy()
    table = grouped.agg(F.array(*hits).alias("h"))
    return table.select(*([by] if by else []), F.explode("h").alias("h")).select(*([by] if by else []), "h.k", "h.recall")


def recall_curve(df: DataFrame, rank: str) -> DataFrame:
    """(rank, n, recall): how many rows have each rank, and the share found up to it."""
    counts = df.filter(F.col(rank) >= 1).groupBy(rank).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    # one row for each rank, which the length of a candidate list bounds
    running = F.sum("n").over(W.Window.orderBy(rank))
    return counts.crossJoin(F.broadcast(total)).select(rank, "n", (running / F.col("total")).alias("recall"))


def macro_micro(df: DataFrame, group: str, correct: str) -> DataFrame:
    """One row: micro accuracy over all rows, macro accuracy over the groups that have any correct row."""
    per = df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(correct).alias("c"))
    return per.agg((F.sum("c") / F.sum("n")).alias("micro"), F.avg(F.when(F.col("c") > 0, F.col("c") / F.col("n"))).alias("macro"))


def span_rates(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Rates of predicted spans that are gold ones; both have the keys, each different."""
    hits = gold.select(*keys).intersect(predicted.select(*keys))
    counts = [f.agg(F.count("*").alias(n)) for f, n in ((hits, "tp"), (predicted, "predicted"), (gold, "gold"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2]).select("tp", "predicted", "gold", *rates(F.col("tp"), F.col("predicted"), F.col("gold")))


def _once(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def masked_softmax(scores: Column, mask: Column) -> Column:
    """Probabilities over the scores whose mask is 1; 0 for the others."""
    known = F.zip_with(scores, mask, lambda s, m: F.when(m == 1, s.cast("double")))

    def raised(z: Column) -> Column:
        return F.zip_with(z, F.array_repeat(F.array_max(z), F.size(z)), lambda x, top: F.coalesce(F.exp(x - top), F.lit(0.0)))

    return _once(known, lambda z: _once(raised(z), lambda e: scaled(e, F.aggregate(e, F.lit(0.0), lambda a, b: a + b))))


@F.pandas_udf(T.StructType([T.StructField("weak", T.IntegerType()), T.StructField("strong", T.IntegerType())]))
def span_matches(gold: pd.Series, predicted: pd.Series) -> pd.DataFrame:
    """Longest common subsequences of two lists of (entity, start, end), each by end: weak if the entities agree and the spans overlap, strong if both agree."""

    def longest(a: list, b: list, same) -> int:
        best = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                best[i, j] = best[i - 1, j - 1] + 1 if same(x, y) else max(best[i - 1, j], best[i, j - 1])
        return int(best[-1, -1])

    rows = []
    for g, p in zip(gold, predicted):
        a, b = (sorted(((s["entity"].lower(), s["start"], s["end"]) for s in x), key=lambda s: s[2]) for x in (g if g is not None else [], p if p is not None else []))
        rows.append((longest(a, b, lambda x, y: x[0] == y[0] and x[1] < y[2] and y[1] < x[2]), longest(a, b, lambda x, y: x == y)))
    return pd.DataFrame(rows, columns=["weak", "strong"])


def precision_at(df: DataFrame, rank: str, ks: list[int]) -> DataFrame:
    """(k, precision, unnormalized, normalized): rows whose one right answer has 1-based rank k at most, over k answers each, over all rows, and over the rows that have it at all (rank 0: not)."""
    hit = lambda k: F.avg(F.when(F.col(rank).between(1, k), 1.0).otherwise(0.0))
    found = F.count_if(F.col(rank) >= 1)
    each = [F.struct(F.lit(k).alias("k"), (hit(k) / k).alias("precision"), hit(k).alias("unnormalized"), F.try_divide(F.count_if(F.col(rank).between(1, k)), found).alias("normalized")) for k in ks]
    return df.agg(F.array(*each).alias("e")).select(F.explode("e").alias("e")).select("e.*")


def focal_loss(p: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """The loss of a right label's probability, small where that is already large."""
    return -alpha * F.pow(1 - p, F.lit(gamma)) * F.log(p)


def stage_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): the rows of each table, counted where they are."""
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()))
