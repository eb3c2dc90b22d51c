"""Nearest neighbours: exact in blocks, over inverted lists, over hashed projections; adaptive cut-offs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import arrays as A
from ..functions.staging import stage

#: Rows of either side that meet in one task, where their number is bounded whatever they hold.
CHUNK = 4096
#: Else they are bounded by the bytes of their vectors, as each row is copied to every chunk of the other side; rows at most, and products that are held at once.
CHUNK_BYTES, CHUNK_ROWS, HELD = 32 << 20, 1 << 16, 1 << 21
#: Chunks of more than CHUNK rows that a side gets at least, so that few rows don't end in one task.
SPREAD = 8


def chunk_rows(df: DataFrame) -> int:
    """How many rows of df (v: arrays of doubles of one length) make a chunk of CHUNK_BYTES."""
    first = df.select(F.size("v")).head(1)
    return max(CHUNK, min(CHUNK_ROWS, CHUNK_BYTES // (8 * max(1, first[0][0])))) if first else CHUNK


def chunk_pairs(left: DataFrame, right: DataFrame, meet: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, chunk: int = CHUNK, also: tuple[str, ...] = (), spread: int = 1) -> DataFrame:
    """meet(left rows, right rows) for all pairs of chunks of each block; both frames have block, id and v, and the columns ``also``.

    A block's rows are dealt into chunks by a hash of their id, so that no task holds more than two
    chunks, however large the block; a block has ``spread`` chunks at least, if they have CHUNK rows.
    """
    sizes = [f.groupBy("block").agg(F.greatest(F.ceil(F.count("*") / chunk), F.least(F.lit(spread), F.ceil(F.count("*") / CHUNK))).cast("int").alias(n)) for f, n in ((left, "nl"), (right, "nr"))]
    both = stage(sizes[0].join(sizes[1], "block"), "sizes")
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = left.join(both, "block").select("block", own("nl").alias("l"), every("nr").alias("r"), F.lit(True).alias("left"), "id", "v", *also)
    b = right.join(both, "block").select("block", every("nl").alias("l"), own("nr").alias("r"), F.lit(False).alias("left"), "id", "v", *also)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x, y = part[part["left"]], part[~part["left"]]
        return meet(x, y) if len(x) and len(y) else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])

    return a.unionByName(b).groupBy("block", "l", "r").applyInPandas(run, schema)


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.float64)


def blocked_top(queries: DataFrame, data: DataFrame, k: int, skip_self: bool = True, chunk: int | None = None) -> DataFrame:
    """(id, rank, other, score): of each query its k largest inner products within its block, ties to the smaller id.

    Both frames have block, id (long) and v (array of one length, without nulls). A row may be in
    several blocks; an other that is met in several counts once.
    """

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        ids, vectors, out = y["id"].to_numpy(), _matrix(y["v"]), []
        order = np.argsort(ids)
        ids, vectors = ids[order], vectors[order]
        step, whole = max(1, HELD // len(ids)), _matrix(x["v"])
        for begin in range(0, len(x), step):
            scores = np.round(whole[begin : begin + step] @ vectors.T, 12)
            own = x["id"].to_numpy()[begin : begin + step]
            if skip_self:
                scores[own[:, None] == ids] = -np.inf
            # of each row those not below its k-th largest, by falling score; ids ascend, so of equal ones the smaller goes first
            least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] if k < len(ids) else np.full(len(own), -np.inf)
            row, at = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
            best = np.lexsort((at, -scores[row, at], row))
            row, at = row[best], at[best]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, at = row[place < k], at[place < k]
            out.append(pd.DataFrame({"id": own[row], "other": ids[at], "score": scores[row, at]}))
        return pd.concat(out)

    met = chunk_pairs(queries, data, meet, "id long, other long, score double", chunk or chunk_rows(data), spread=1 if chunk else SPREAD).groupBy("id", "other").agg(F.max("score").alias("score"))
    ranked = met.withColumn("rank", F.row_number().over(W.Window.partitionBy("id").orderBy(F.desc("score"), "other")))
    return ranked.filter(F.col("rank") <= k).select("id", "rank", "other", "score")


def cosines(queries: DataFrame, data: DataFrame, chunk: int = CHUNK // 4) -> DataFrame:
    """(id, other, score): the cosine of each query with every other row of its block, 0 where either has no length or no vector. A task gives the pairs of two chunks, so chunks are small."""
    whole = lambda f: f.withColumn("v", F.when(~F.exists("v", lambda x: x.isNull()), F.col("v")))

    def matrix(v: pd.Series, width: int) -> np.ndarray:
        return np.stack([np.zeros(width) if r is None else np.asarray(r, dtype=np.float64) for r in v])

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        width = max((len(r) for r in (*x["v"], *y["v"]) if r is not None), default=0)
        a, b = matrix(x["v"], width), matrix(y["v"], width)
        size = np.sqrt(np.einsum("ij,ij->i", a, a)[:, None] * np.einsum("ij,ij->i", b, b))
        scores = np.divide(a @ b.T, size, out=np.zeros_like(size), where=size != 0)
        i, j = np.nonzero(x["id"].to_numpy()[:, None] != y["id"].to_numpy())
        return pd.DataFrame({"id": x["id"].to_numpy()[i], "other": y["id"].to_numpy()[j], "score": scores[i, j]})

    return chunk_pairs(whole(queries), whole(data), meet, "id long, other long, score double", chunk)


def exact_top(queries: DataFrame, data: DataFrame, k: int, skip_self: bool = True) -> DataFrame:
    """blocked_top with all rows in one block."""
    return blocked_top(queries.withColumn("block", F.lit(0)), data.withColumn("block", F.lit(0)), k, skip_self)


def nearest_parent(children: DataFrame, parents: DataFrame, fall_back: bool) -> DataFrame:
    """(id, parent, sim): the parent of the largest cosine in the child's block, ties to the smaller id.

    Where the block has no parent: the best of all parents if fall_back, else null.
    """
    unit = lambda f: f.select("block", "id", A.normalized(F.col("v")).alias("v"))
    kids, olds = unit(children), unit(parents)
    best = blocked_top(kids, olds, 1, skip_self=False)
    if fall_back:
        alone = kids.join(olds.select("block").distinct(), "block", "left_anti")
        best = best.unionByName(exact_top(alone.select("id", "v"), olds.select("id", "v"), 1, skip_self=False))
    return children.select("id").join(best.select("id", F.col("other").alias("parent"), F.col("score").alias("sim")), "id", "left")


def elbow(df: DataFrame, key: str, sim: str, least: int = 1, most: int = 5) -> DataFrame:
    """(key, keep): how many of a key's falling similarities to keep: the place farthest from the line between the first and the last, the first of equals, from least to most; all of at most least."""
    down = W.Window.partitionBy(key).orderBy(F.desc(sim))
    whole = W.Window.partitionBy(key)
    rows = df.select(key, F.col(sim).alias("s"), F.row_number().over(down).alias("r"))
    rows = rows.withColumn("n", F.count("*").over(whole)).withColumn("first", F.max("s").over(whole)).withColumn("last", F.min("s").over(whole))
    run, drop = F.col("n") - 1, F.col("last") - F.col("first")
    away = F.abs(run * (F.col("s") - F.col("first")) - drop * (F.col("r") - 1)) / F.sqrt(run * run + drop * drop)
    at = rows.withColumn("d", F.round(away, 12)).groupBy(key).agg(F.max("n").alias("n"), F.max_by("r", F.struct("d", -F.col("r"))).alias("at"))
    return at.select(key, F.when(F.col("n") <= least, F.col("n")).otherwise(F.greatest(F.least(F.col("at"), F.lit(most)), F.lit(least))).cast("int").alias("keep"))


def parents_by_class(children: DataFrame, parents: DataFrame, top: int = 20, threshold: float = 0.86, least: int = 1, most: int = 5) -> DataFrame:
    """(id, parent, sim): one to five parents a child: of its top candidates by cosine in its classes one layer up, else in layer 3, what the elbow keeps and the threshold lets pass, but at least ``least``.

    Both frames have id, v, codes (array) and layer; a class is a code's first character.
    """
    classes = lambda f: f.select("id", "layer", A.normalized(F.col("v")).alias("v"), F.explode(F.array_distinct(F.transform("codes", lambda c: F.substring(c, 1, 1)))).alias("class"))
    kids, olds = classes(children), classes(parents).withColumn("block", F.concat_ws("|", "class", "layer"))
    there = olds.select("block").distinct().withColumn("there", F.lit(True))
    wanted = kids.withColumn("block", F.concat_ws("|", "class", F.col("layer") - 1)).join(there, "block", "left").withColumn("block", F.when(F.col("there"), F.col("block")).otherwise(F.concat(F.col("class"), F.lit("|3"))))
    found = stage(blocked_top(wanted.select("block", "id", "v"), olds.select("block", "id", "v"), top), "candidates")
    kept = found.join(elbow(found, "id", "score", least, most), "id").filter((F.col("rank") <= F.col("keep")) & ((F.col("score") >= threshold) | (F.col("rank") <= least)))
    return kept.select("id", F.col("other").alias("parent"), F.col("score").alias("sim"))


def inverted_lists_top(queries: DataFrame, data: DataFrame, k: int, lists: int = 100, probes: int = 10, sample: int = 20_000, seed: int = 7) -> DataFrame:
    """blocked_top over cells: k-means on at most ``sample`` rows, each row in its nearest cell, a query against the ``probes`` cells nearest to it. Approximate."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    few = data.orderBy(F.xxhash64("id", F.lit(seed))).limit(sample).select(array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    centres = np.array(KMeans(k=lists, seed=seed, maxIter=10).fit(few).clusterCenters())

    def cells(n: int):
        @F.pandas_udf("array<int>")
        def nearest(v: pd.Series) -> pd.Series:
            x = _matrix(v)
            d = (centres**2).sum(axis=1) - 2 * x @ centres.T
            return pd.Series(list(np.argsort(d, axis=1, kind="stable")[:, :n].astype(np.int32)))

        return nearest

    dealt = lambda f, n: f.select("id", "v", F.explode(cells(n)(F.col("v"))).alias("block"))
    return blocked_top(dealt(queries, min(probes, len(centres))), dealt(data, 1), k)


def hashed_projections_top(queries: DataFrame, data: DataFrame, k: int, tables: int = 16, bits: int = 6, seed: int = 7) -> DataFrame:
    """blocked_top over the signs of random projections: in each table rows with equal signs meet. Vectors get one more dimension, so that the largest inner product is the nearest. Approximate."""
    largest = data.agg(F.max(A.dot(F.col("v"), F.col("v")))).first()[0] or 0.0

    def keys(extra: bool):
        @F.pandas_udf("array<long>")
        def sign_keys(v: pd.Series) -> pd.Series:
            x = _matrix(v)
            last = np.sqrt(np.maximum(0, largest - (x**2).sum(axis=1))) if extra else np.zeros(len(x))
            x = np.column_stack([x, last])
            planes = np.random.default_rng(seed).standard_normal((x.shape[1], tables * bits))
            signs = ((x @ planes) > 0).reshape(len(x), tables, bits)
            return pd.Series(list((signs * (1 << np.arange(bits))).sum(axis=2) + np.arange(tables) * (1 << bits)))

        return sign_keys

    dealt = lambda f, extra: f.select("id", "v", F.explode(keys(extra)(F.col("v"))).alias("block"))
    return blocked_top(dealt(queries, False), dealt(data, True), k)


def reduced(df: DataFrame, k: int) -> DataFrame:
    """df (id, v) with v along the k directions of its largest variance, each turned so that its largest entry is positive.

    The covariance of the dimensions is summed up in the cluster; only it and the directions come to the driver.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    few = df.select(array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    axes = PCA(k=k, inputCol="features").fit(few).pc.toArray()
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])

    @F.pandas_udf("array<double>")
    def along(v: pd.Series) -> pd.Series:
        return pd.Series(list(_matrix(v) @ axes)) if len(v) else pd.Series([], dtype=object)

    return df.withColumn("v", along("v"))


def top_of(scores: Column, names: Column, k: int) -> Column:
    """Names of the k largest scores, the first of equals first."""
    z = F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(z), 1, k), lambda x: F.get(names, x["i"]))
