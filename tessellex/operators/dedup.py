"""De-duplication of records and entities."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.staging import stage
from .ids import dense_ids
from .similarity import CHUNK, chunk_pairs


def merge_phrases(df: DataFrame, name: str, old_id: str, codes: str) -> DataFrame:
    """(name, old_ids, ipc_codes, first_id) of each name: all its ids, the union of its comma-joined codes, both sorted."""
    parts = F.filter(F.transform(F.split(codes, ",", -1), lambda w: F.trim(w)), lambda x: x != "")
    sets = df.groupBy(name).agg(F.array_sort(F.collect_set(old_id)).alias("old_ids"), F.min(old_id).alias("first_id"))
    found = df.select(name, F.explode(parts).alias("c")).groupBy(name).agg(F.array_sort(F.collect_set("c")).alias("ipc_codes"))
    return sets.join(found, name, "left").withColumn("ipc_codes", F.coalesce("ipc_codes", F.array().cast("array<string>")))


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order that is total."""
    return df.withColumn("_n", F.row_number().over(W.Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def dedupe_entities(df: DataFrame, name: str, code: str, order: str) -> DataFrame:
    """One row a name: what its first row has, and the sorted different codes of all."""
    rest = [c for c in df.columns if c not in (name, code)]
    kept = df.groupBy(name).agg(F.min_by(F.struct(*rest), order).alias("r"), F.array_sort(F.collect_set(code)).alias(code))
    return kept.select(name, "r.*", code)


def dedupe_exact(df: DataFrame) -> DataFrame:
    """One row for each (lower-cased trimmed name, parent_ipc): the best by score, then sim (both falling), then id; aliases are the sorted spellings where there are several.

    df: id, name, parent_ipc, score, sim.
    """
    key = [F.lower(F.trim("name")).alias("key"), F.coalesce("parent_ipc", F.lit("")).alias("group")]
    order = F.struct((-F.coalesce("score", F.lit(0.0))).alias("a"), (-F.coalesce("sim", F.lit(0.0))).alias("b"), F.col("id").alias("c"))
    best = df.select(*key, order.alias("o"), F.struct("id", "name", "parent_ipc", "score", "sim").alias("r")).groupBy("key", "group").agg(F.min_by("r", "o").alias("r"), F.array_sort(F.collect_set("r.name")).alias("names"))
    return best.select("r.*", F.when(F.size("names") > 1, F.col("names")).otherwise(F.array().cast("array<string>")).alias("aliases"))


def dedupe_greedy(df: DataFrame, threshold: float = 0.6, dim: int = 128, chunk: int = CHUNK) -> DataFrame:
    """Within each parent_ipc, by score and sim falling, then id: each row that is left takes the later ones whose names' character codes have a cosine of at least threshold.

    df: id (unique), name, parent_ipc, score, sim. Gives the takers with the other names as sorted aliases.
    A group of up to ``chunk`` rows is walked by one task. A larger one never meets in a task: in rounds,
    every undecided row without an earlier near one that is undecided becomes a taker, and rows near
    to a taker leave, chunk against chunk; when all are decided, each row that is no taker goes to the
    earliest taker near it. That is what the walk gives.
    """

    def codes(names: pd.Series) -> np.ndarray:
        out = np.zeros((len(names), dim))
        for k, name in enumerate(names):
            np.add.at(out[k], [ord(c) * 131 % dim for c in (name or "").lower()], 1.0)
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, lengths, out=np.zeros_like(out), where=lengths > 0)

    def near(x: pd.Series, y: pd.Series) -> np.ndarray:
        return codes(x) @ codes(y).T >= threshold - 1e-12

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("n", ignore_index=True)
        vectors, left, pairs = codes(part["v"]), np.arange(len(part)), []
        while len(left):
            taken = vectors[left] @ vectors[left[0]] >= threshold - 1e-12
            taken[0] = True
            pairs += [(part["id"][k], part["id"][left[0]]) for k in left[taken]]
            left = left[~taken]
        return pd.DataFrame(pairs, columns=["id", "taker"])

    def behind(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        """Rows of x with an earlier near one in y."""
        held = (near(x["v"], y["v"]) & (y["id"].to_numpy() < x["id"].to_numpy()[:, None])).any(axis=1)
        return pd.DataFrame({"id": x["id"][held]})

    def earliest(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(y["id"].to_numpy())
        close = near(x["v"], y["v"].iloc[order])
        has = close.any(axis=1)
        return pd.DataFrame({"id": x["id"].to_numpy()[has], "taker": y["id"].to_numpy()[order][close[has].argmax(axis=1)]})

    zero = F.lit(0.0)
    rows = df.select("id", "name", F.coalesce("parent_ipc", F.lit("")).alias("parent_ipc"), (-F.coalesce("score", zero)).alias("a"), (-F.coalesce("sim", zero)).alias("b"))
    ordered = stage(dense_ids(rows, ["a", "b", "id"], "n"), "ordered")
    ranked = ordered.select(F.col("parent_ipc").alias("block"), F.col("n").alias("id"), F.col("name").alias("v"))
    sizes = ranked.groupBy("block").agg(F.count("*").alias("size"))
    large = stage(sizes.filter(F.col("size") > chunk).select("block"), "large")
    whole = ranked.join(large, "block", "left_anti").withColumn("n", F.col("id"))
    pairs = whole.groupBy("block").applyInPandas(walk, "id long, taker long")
    left, takers = stage(ranked.join(large, "block", "left_semi"), "left"), []
    every = left
    while left.head(1):
        waiting = chunk_pairs(left, left, behind, "id long", chunk).distinct()
        new = stage(left.join(waiting, "id", "left_anti").select("block", "id", "v"), "takers")
        takers.append(new)
        gone = chunk_pairs(left, new, earliest, "id long, taker long", chunk).select("id").unionByName(new.select("id")).distinct()
        left = stage(left.join(gone, "id", "left_anti").select("block", "id", "v"), "left")
    if takers:
        all_takers = stage(reduce(DataFrame.unionByName, takers), "all_takers")
        rest = every.join(all_takers.select("id"), "id", "left_anti").select("block", "id", "v")
        found = chunk_pairs(rest, all_takers, earliest, "id long, taker long", chunk).groupBy("id").agg(F.min("taker").alias("taker"))
        pairs = pairs.unionByName(found).unionByName(all_takers.select("id", F.col("id").alias("taker")))
    names = pairs.join(ordered.select(F.col("n").alias("id"), F.col("name").alias("other")), "id").groupBy("taker").agg(F.collect_set("other").alias("names"))
    done = names.join(ordered.select(F.col("n").alias("taker"), "id", "name", "parent_ipc"), "taker")
    others = F.array_sort(F.array_except("names", F.array(F.coalesce("name", F.lit("")), F.lit(""))))
    return done.select("id", "name", "parent_ipc", others.alias("aliases"))


def union_first(frames: list[DataFrame], key: str) -> DataFrame:
    """Rows of all frames, of each key those of the first frame that has it."""
    tagged = [f.withColumn("_rank", F.lit(k)) for k, f in enumerate(frames)]
    every = tagged[0]
    for f in tagged[1:]:
        every = every.unionByName(f, allowMissingColumns=True)
    first = every.groupBy(key).agg(F.min("_rank").alias("_rank"))
    return every.join(first, [key, "_rank"]).drop("_rank")
