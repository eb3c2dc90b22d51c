"""Lookup cascades, id remapping inside nested spans, and link counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.staging import stage


def lookup_cascade(df: DataFrame, tries: list[Column], table: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """df with the value that table has for the first of several keys it knows; null for none. table's keys are unique.

    All keys of a row are looked up in one join: they are exploded with their place, and each row keeps
    the first place found. Rows are numbered once, in a table in the shared folder, so that they find
    themselves again however often a task runs. Columns of df may have any names.
    """
    rows = stage(df.select(F.struct(*(F.col(f"`{c}`").alias(c) for c in df.columns)).alias("row"), F.array(*tries).alias("tries"), F.monotonically_increasing_id().alias("number")), "rows")
    asked = rows.select("number", F.posexplode("tries").alias("place", "asked")).filter("asked is not null")
    found = asked.join(table.select(F.col(key).alias("asked"), F.col(value).alias("value")), "asked").groupBy("number").agg(F.min_by("value", "place").alias("value"))
    return rows.join(found, "number", "left").select("row.*", F.col("value").alias(out))


def remap_spans(df: DataFrame, spans: str, mapping: DataFrame, row_id: str) -> DataFrame:
    """df with the fot_id of each span replaced by new_id of mapping (old_id, new_id, unique); unknown ids stay, and so does the order.

    row_id is unique. Rows without spans keep what they have.
    """
    each = df.select(row_id, F.posexplode(spans).alias("_at", "s"))
    known = each.join(mapping.select(F.col("old_id").alias("_old"), "new_id"), F.col("s.fot_id") == F.col("_old"), "left")
    new = known.select(row_id, "_at", F.struct(F.coalesce("new_id", "s.fot_id").alias("fot_id"), F.col("s.start").alias("start"), F.col("s.end").alias("end")).alias("s"))
    lists = new.groupBy(row_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "s"))), lambda x: x["s"]).alias("_new"))
    return df.join(lists, row_id, "left").withColumn(spans, F.coalesce("_new", spans)).drop("_new")


def incoming_links(links: DataFrame, entities: DataFrame) -> DataFrame:
    """entities (id, title) with num_incoming_links: how many link targets are the title, or the id as text."""
    by_title = links.groupBy("target").agg(F.count("*").alias("n"))
    counted = entities.select("id", F.explode(F.array_distinct(F.array("title", F.col("id").cast("string")))).alias("target")).join(by_title, "target").groupBy("id").agg(F.sum("n").alias("num_incoming_links"))
    return entities.join(counted, "id", "left").withColumn("num_incoming_links", F.coalesce("num_incoming_links", F.lit(0)).cast("long"))


def coreferences(mentions: DataFrame, persons: DataFrame) -> DataFrame:
    """Mention pairs of a document where one is a whole-word proper part of a person's longer one.

    Both have doc, mention; persons' names are cut into their runs of words, so the join is an equality
    of (doc, run) instead of a comparison of all pairs.
    """
    words = F.split("mention", " ")
    runs = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(F.lit(1), F.size(words) - i + 1), lambda n: F.array_join(F.slice(words, i, n), " ")))))
    parts = persons.select("doc", F.col("mention").alias("full"), F.explode(runs).alias("mention")).filter("mention <> full")
    return mentions.select("doc", "mention").distinct().join(parts.distinct(), ["doc", "mention"])


def aligned(left: DataFrame, right: DataFrame, text: str, order: str) -> DataFrame:
    """Pairs of rows whose texts agree in letters and digits, lower-cased, the n-th with the n-th of the same document."""

    def keyed(df: DataFrame, name: str) -> DataFrame:
        key = F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}_]", ""))
        n = F.row_number().over(W.Window.partitionBy("doc", "_key").orderBy(order))
        return df.withColumn("_key", key).withColumn("_n", n).select("doc", "_key", "_n", F.col(order).alias(f"{name}_{order}"), F.col(text).alias(f"{name}_{text}"))

    return keyed(left, "left").join(keyed(right, "right"), ["doc", "_key", "_n"]).drop("_key", "_n")
