"""Identifiers: dense numbers over a total order without a one-partition window, and their formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.staging import stage


def dense_ids(df: DataFrame, order_by: list[str], out: str = "id", start: int = 1) -> DataFrame:
    """df with consecutive numbers from ``start`` in the order of columns that together are unique.

    Rows are sorted into ranges, written once, and numbered within their range; a range begins after
    the counts of those before it. The driver gets one count for each range.
    """
    ranged = stage(df.repartitionByRange(*order_by).withColumn("_range", F.spark_partition_id()), "ranged")
    at, offsets = start, []
    for r in sorted(ranged.groupBy("_range").count().collect(), key=lambda r: r["_range"]):
        offsets.append((r["_range"], at))
        at += r["count"]
    if not offsets:
        return df.withColumn(out, F.lit(None).cast("long"))
    begins = F.broadcast(df.sparkSession.createDataFrame(offsets, "_range int, _begin long"))
    number = F.row_number().over(W.Window.partitionBy("_range").orderBy(*order_by))
    return ranged.withColumn("_n", number).join(begins, "_range").withColumn(out, F.col("_begin") + F.col("_n") - 1).drop("_range", "_begin", "_n")


def patent_id(number: Column) -> Column:
    """A0000001 for 1: a letter for each ten million, then the rest in seven digits (eight for the ten-millionth)."""
    rest = (((number - 1) % 10_000_000) + 1).cast("string")
    return F.concat(F.char(F.lit(65) + F.floor((number - 1) / 10_000_000)), F.when(F.length(rest) < 7, F.lpad(rest, 7, "0")).otherwise(rest))


def title_groups(df: DataFrame, title: str, number: str, code: str, order: str) -> DataFrame:
    """(patent_id, title, publication_numbers, ipc_codes) of each different non-empty title, numbered by first appearance; the sets sorted."""
    rows = df.select(F.trim(title).alias("title"), F.col(number).cast("string").alias("pub"), F.trim(code).alias("ipc"), F.col(order).alias("ord")).filter("title <> ''")
    groups = rows.groupBy("title").agg(F.min("ord").alias("first"), F.array_sort(F.collect_set("pub")).alias("publication_numbers"), F.array_sort(F.collect_set("ipc")).alias("ipc_codes"))
    return dense_ids(groups, ["first", "title"], "n").select(patent_id(F.col("n")).alias("patent_id"), "title", "publication_numbers", "ipc_codes", "first")


def reindexed(names: DataFrame, name: str, after: int) -> DataFrame:
    """(name, new_id): names ascending, numbered from after + 1."""
    return dense_ids(names.select(name).distinct(), [name], "new_id", after + 1)
