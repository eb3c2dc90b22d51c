"""Predicates and candidate filters over flat and nested records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text as T


def matches(rules: dict[str, str]) -> Column:
    """Whether every named column, as text, contains its pattern; null doesn't match."""
    return reduce(lambda a, b: a & b, (F.coalesce(F.col(c).cast("string").rlike(p), F.lit(False)) for c, p in rules.items()), F.lit(True))


def flatten_candidates(blocks: DataFrame, lists: list[str]) -> DataFrame:
    """One row for each candidate of nested lists (columns of a block's texts), with the list's name and 1-based place in it.

    blocks: ipc, level, text and each list as array<struct<id, name, text, url, score>>.
    """
    each = [F.transform(F.coalesce(F.col(c), F.array()), lambda x, i: F.struct(F.lit(c).alias("list"), (i + 1).alias("pos"), x.alias("c"))) for c in lists]
    return blocks.select("ipc", "level", "text", F.explode(F.concat(*each)).alias("e")).select("ipc", "level", F.col("text").alias("query_text"), "e.list", "e.pos", "e.c.*")


def rules_filter(candidates: DataFrame, blacklist: list[str], include: dict[str, str], exclude: dict[str, str]) -> DataFrame:
    """Candidates whose name isn't listed, that match all include patterns and not all exclude patterns."""
    kept = candidates.filter(~F.coalesce(F.col("name").isin(*blacklist), F.lit(False)) if blacklist else F.lit(True)).filter(matches(include))
    return kept.filter(~matches(exclude)) if exclude else kept


def positional_filter(candidates: DataFrame, keep: DataFrame, order: list[str]) -> DataFrame:
    """Candidates at the places that keep lists by (ipc, query_text, list, pos); of each id the first in the given order stays. keep may carry parent_id."""
    joined = candidates.join(keep, ["ipc", "query_text", "list", "pos"])
    return joined.withColumn("_n", F.row_number().over(W.Window.partitionBy("id").orderBy(*order))).filter("_n = 1").drop("_n")


def whitelist(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """Entities for a list of names (column entry): ``name[CODE]`` is looked up capitalized and dropped if absent, at level 1; a plain name has id -1 if absent, at level 2."""
    coded = F.col("entry").rlike(r"^.+\[\w+\]")
    named = names.select(
        "entry",
        coded.alias("coded"),
        F.when(coded, T.capitalize(F.trim(F.regexp_extract("entry", r"^(.+)\[(\w+)\]", 1)))).otherwise(F.trim("entry")).alias("name"),
        F.when(coded, F.regexp_extract("entry", r"^(.+)\[(\w+)\]", 2)).otherwise("").alias("ent_ipc"),
    )
    found = named.join(catalog.select(F.col("title").alias("name"), F.col("id").alias("found"), F.col("text").alias("found_text")), "name", "left")
    kept = found.filter(~F.col("coded") | F.col("found").isNotNull())
    url = F.when(F.col("found").isNotNull(), T.page_url(F.col("found"))).otherwise("")
    return kept.select(F.coalesce("found", F.lit(-1)).cast("long").alias("id"), "name", F.coalesce("found_text", F.lit("")).alias("text"), url.alias("url"), F.when(F.col("coded"), 1).otherwise(2).alias("level"), "ent_ipc")


def not_in(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys don't occur in other."""
    return df.join(other.select(*keys).distinct(), keys, "left_anti")


def boundary_tags_fit(tags: Column, bad: tuple[str, ...] = ("ADP", "DET", "CCONJ", "SCONJ", "PRON", "AUX")) -> Column:
    """Whether neither the first nor the last tag of a span is one of bad."""
    return ~F.element_at(tags, 1).isin(*bad) & ~F.element_at(tags, -1).isin(*bad)


def long_enough(df: DataFrame, tokens: str, least: int) -> DataFrame:
    """Documents with at least so many tokens."""
    return df.filter(F.col(tokens) >= least)


def without_disambiguation(df: DataFrame, title: str = "title", description: str = "description") -> DataFrame:
    """Pages that neither their title nor their description calls a disambiguation page."""
    told = F.coalesce(F.col(title).rlike("[Dd]isambiguation"), F.lit(False)) | F.coalesce(F.contains(description, F.lit("disambiguation page")), F.lit(False))
    return df.filter(~told)


def gold_within(df: DataFrame, candidates: str, gold: str, top: int | None = None) -> DataFrame:
    """Examples whose gold candidate is among the first ``top``, or among all."""
    at = F.array_position(candidates, F.col(gold))
    return df.filter((at > 0) & (at <= top) if top else at > 0)


def fair_spans(df: DataFrame, start: str, end: str, most: int) -> DataFrame:
    """Spans that begin no later than they end and have at most ``most`` tokens between."""
    return df.filter((F.col(end) >= F.col(start)) & (F.col(end) - F.col(start) <= most))


def passing(df: DataFrame, mode: str, threshold: float, joint: str = "joint", mention: str = "mention") -> DataFrame:
    """Rows whose joint score, mention score or both pass the threshold."""
    fits = {"joint": F.col(joint) >= threshold, "mention": F.col(mention) >= threshold}
    return df.filter(fits["joint"] & fits["mention"] if mode == "both" else fits[mode])


def levels_in_catalog(triples: DataFrame, catalog: DataFrame, predicate: str, levels: tuple[str, ...] = ("0", "1")) -> DataFrame:
    """(subject, name) of triples whose subject has one of the levels and whose name the catalog (title) knows."""
    kept = triples.filter(F.col("predicate").contains(predicate) & F.col("literal").isin(*levels)).select("subject").distinct()
    names = triples.filter(F.col("predicate").contains("name")).select("subject", F.col("literal").alias("name"))
    return names.join(kept, "subject", "left_semi").join(catalog.select(F.col("title").alias("name")).distinct(), "name", "left_semi").select("subject", "name")
