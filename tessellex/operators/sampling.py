"""Splits and samples that are the same in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.staging import salted, small, stage
from .ids import dense_ids
from .matching import substring_matches


def _mixed(seed: int, *parts) -> Column:
    """A digest of the parts and the seed, to order by."""
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def group_split(df: DataFrame, group: str, key: str, tagged: Column, shares: tuple[float, float] = (0.8, 0.1), unknown: str = "unknown_entity", seed: int = 42) -> DataFrame:
    """df with split (train, valid or test): of the different groups, in the order of a digest, the first share is train, the next valid, the rest test, and all rows of a group go with it.

    Rows of the group ``unknown`` are split by their keys instead, those that are ``tagged`` and the
    others each by the shares; rows with a null or empty group are train. Counts are rounded down.
    """
    name = F.coalesce(F.col(group).cast("string"), F.lit(""))
    kind = F.when(name == "", -1).when(name != unknown, 0).when(F.coalesce(tagged, F.lit(False)), 1).otherwise(2)
    rows = df.withColumn("_kind", kind).withColumn("_unit", F.when(F.col("_kind") == 0, name).otherwise(F.coalesce(F.col(key).cast("string"), F.lit(""))))
    units = rows.filter("_kind >= 0").select("_kind", "_unit").distinct().withColumn("_order", _mixed(seed, F.col("_unit")))
    numbered = dense_ids(units, ["_kind", "_order", "_unit"], "_number", 0)
    counts = {r["_kind"]: r["count"] for r in numbered.groupBy("_kind").count().collect()}  # three kinds
    place, begin = F.lit("train"), 0
    for k in range(3):
        n = counts.get(k, 0)
        first, second = (begin + int(n * shares[0]), begin + int(n * shares[0]) + int(n * shares[1]))
        own = F.when(F.col("_number") < first, "train").when(F.col("_number") < second, "valid").otherwise("test")
        place, begin = F.when(F.col("_kind") == k, own).otherwise(place), begin + n
    known = small(stage(numbered.select("_kind", "_unit", place.alias("split")), "split"))
    return salted(rows, known, ["_kind", "_unit"], "left").withColumn("split", F.coalesce("split", F.lit("train"))).drop("_kind", "_unit")


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, those of the smallest digest of the key. Rows are sorted into ranges and numbered, so that no task holds all n."""
    return dense_ids(df.withColumn("_order", _mixed(seed, F.col(key).cast("string"))), ["_order", key], "_number").filter(F.col("_number") <= n).drop("_order", "_number")


def balanced(df: DataFrame, text: str, key: str, vocabulary: DataFrame, term: str, times: int = 2, seed: int = 42) -> DataFrame:
    """(key, positive): all rows whose text contains a term of the vocabulary, and ``times`` as many of the others, those of the smallest digest."""
    hits = substring_matches(df, text, key, vocabulary, term).select(F.col("key").alias(key)).distinct()
    positive = df.select(key).join(hits, key, "left_semi").select(key, F.lit(True).alias("positive"))
    rest = df.select(key).join(hits, key, "left_anti")
    return positive.unionByName(sample(rest, key, times * positive.count(), seed).select(key, F.lit(False).alias("positive")))


def halves(df: DataFrame, order: str) -> DataFrame:
    """df with half 1 for the first (n + 1) // 2 rows in order, and for those equal to the last of them, else 2. The border is found in sorted ranges."""
    border = dense_ids(df.select(order), [order], "_number").filter(F.col("_number") == (df.count() + 1) // 2).head(1)
    return df.withColumn("half", F.when(F.col(order) <= F.lit(border[0][0] if border else None), 1).otherwise(2))


def first_rows(df: DataFrame, by: str, order: str, n: int, *ties: str) -> DataFrame:
    """The first n rows of each group; equal ones in the order of ``ties``, so that the same rows come out however they were dealt."""
    return df.withColumn("_n", F.row_number().over(W.Window.partitionBy(by).orderBy(order, *ties))).filter(F.col("_n") <= n).drop("_n")
