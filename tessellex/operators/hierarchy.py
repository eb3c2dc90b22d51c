"""Density clusters, agglomerative trees within clusters, and layers by depth."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import arrays as A
from ..functions.staging import release, small, stage
from .graph import connected_components
from .similarity import CHUNK, HELD, SPREAD, _matrix, chunk_pairs, chunk_rows


#: Rows that a cell has on average, and cells at most.
CELL_ROWS, CELLS = 256, 256
#: Radians by which a computed angle may be off.
SLACK = 1e-6


class Cells:
    """Pivots, and of each cell the least and greatest angles of its rows to each of them, widened by the reach."""

    def __init__(self, pivots: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.pivots, self.low, self.high = pivots, low, high

    def angles(self, vectors: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(vectors @ self.pivots.T, -1, 1))

    def lets(self, angles: np.ndarray, cell: int) -> np.ndarray:
        """Which rows a cell may hold a neighbour of."""
        return ((angles >= self.low[cell]) & (angles <= self.high[cell])).all(axis=1)


def angle_cells(unit: DataFrame, eps: float, cells: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(visitors, residents) of a table (id, v) of unit vectors: each row lives in the cell (``block``) of its nearest pivot, and visits every cell that can hold a row within cosine distance eps.

    Pivots are rows, by a hash of the id: about one for CELL_ROWS rows, CELLS at most. Angles obey the triangle
    inequality, so a row whose angle to any pivot lies further than that of eps outside the range
    of a cell's own angles to that pivot has no neighbour there. Nothing is lost; rows that point in all
    directions alike visit all cells. The ranges are least and greatest values, aggregated before they
    are shuffled; the driver gets one pair for each two cells.
    """
    known, held = _placed(unit, eps, cells, seed)
    if held is None:
        return known.select("block", "id", "v"), known.select("block", "id", "v")
    return known.select(F.explode("c.met").alias("block"), "id", "v"), known.select(F.col("c.home").alias("block"), "id", "v")


def _placed(unit: DataFrame, eps: float, cells: int | None, seed: int = 7) -> tuple[DataFrame, Cells | None]:
    """(id, v, c) with each row's home cell and those it meets, and the cells; without rows (block, id, v) and none."""
    n = unit.count() if cells is None else 0
    few = unit.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(cells or max(1, min(CELLS, n // CELL_ROWS))).select("v").collect()
    if not few:
        return unit.withColumn("block", F.lit(0)), None
    pivots = np.array([r["v"] for r in few], dtype=np.float64)
    m, reach = len(pivots), float(np.arccos(np.clip(1 - eps, -1, 1))) + SLACK

    def angles(v: pd.Series) -> np.ndarray:
        return Cells(pivots, None, None).angles(_matrix(v))

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high = np.full((m, m), np.inf), np.full((m, m), -np.inf)
        for part in parts:
            a = angles(part["v"])
            np.minimum.at(low, a.argmin(axis=1), a)
            np.maximum.at(high, a.argmin(axis=1), a)
        cell, pivot = np.nonzero(np.isfinite(low))
        yield pd.DataFrame({"cell": cell, "pivot": pivot, "low": low[cell, pivot], "high": high[cell, pivot]})

    low, high = np.full((m, m), np.inf), np.full((m, m), -np.inf)  # a cell without rows lets nothing in
    for r in unit.select("v").mapInPandas(spread, "cell int, pivot int, low double, high double").groupBy("cell", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        low[r["cell"], r["pivot"]], high[r["cell"], r["pivot"]] = r["low"], r["high"]
    held = Cells(pivots, low - reach, high + reach)

    @F.pandas_udf("home int, met array<int>")
    def placed(v: pd.Series) -> pd.DataFrame:
        a = angles(v)
        met = [np.flatnonzero(row).astype(np.int32) for row in np.column_stack([held.lets(a, c) for c in range(m)])]
        return pd.DataFrame({"home": a.argmin(axis=1), "met": met})

    return stage(unit.select("id", "v", placed("v").alias("c")), "cells"), held


def met_pairs(visitors: DataFrame, residents: DataFrame) -> int:
    """How many pairs of rows are compared where these meet."""
    a, b = (f.groupBy("block").agg(F.count("*").alias(n)) for f, n in ((visitors, "a"), (residents, "b")))
    return int(a.join(b, "block").agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0)


def _grouped(known: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(visitors, residents) of placed rows, dealt by groups of cells of about ``chunk`` residents, or of fewer but CHUNK for SPREAD groups: a visitor goes once to each group of which it meets a cell. Residents have their cell."""
    sizes = {r["cell"]: r["count"] for r in known.groupBy(F.col("c.home").alias("cell")).count().collect()}
    chunk = min(chunk, max(CHUNK, sum(sizes.values()) // SPREAD))
    number, filled, groups = 0, 0, []
    for cell in range(max(sizes, default=-1) + 1):
        if filled and filled + sizes.get(cell, 0) > chunk:
            number, filled = number + 1, 0
        filled += sizes.get(cell, 0)
        groups.append(number)
    named = lambda cell: F.get(F.array(*map(F.lit, groups or [0])), cell)
    met = F.filter(F.array_distinct(F.transform("c.met", named)), lambda g: g.isNotNull())
    visitors = known.select(F.explode(met).alias("block"), "id", "v", F.lit(-1).alias("cell"))
    return visitors, known.select(named(F.col("c.home")).alias("block"), "id", "v", F.col("c.home").alias("cell"))


def density_clusters(df: DataFrame, eps: float = 0.5, least: int = 7, chunk: int | None = None, cells: int | None = None) -> DataFrame:
    """(id, cluster): DBSCAN over cosine distance; df has id and v. A cluster is named by its smallest core id, noise is -1.

    A core has ``least`` rows within eps, itself included. A row that is no core joins the cluster of
    the smallest core within eps. Rows are only compared with cells that can hold a neighbour (``_placed``).
    They are copied to groups of cells, chunk against chunk, not to each cell, so what is shuffled
    is a row for each chunk at most; of two chunks' cores only a forest that connects them comes out.
    """
    unit = stage(df.select("id", A.normalized(F.col("v")).alias("v")), "unit")
    known, held = _placed(unit, eps, cells)
    if held is None:
        return unit.select("id", F.lit(-1).cast("long").alias("cluster"))
    chunk = chunk or chunk_rows(unit)
    visitors, residents = _grouped(known, chunk)
    reach = 1 - eps - 1e-12

    def near_parts(x: pd.DataFrame, y: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(left places, right places, whether they are near), for each cell HELD products at a time."""
        a, b, cell = _matrix(x["v"]), _matrix(y["v"]), y["cell"].to_numpy()
        angles = held.angles(a)
        for c in np.unique(cell):
            i, own = np.flatnonzero(held.lets(angles, c)), np.flatnonzero(cell == c)
            for start in range(0, len(own), 4096):
                j = own[start : start + 4096]
                step = HELD // len(j)
                for k in range(0, len(i), step):
                    part = i[k : k + step]
                    yield part, j, a[part] @ b[j].T >= reach

    def count(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(len(x), dtype=np.int64)
        for i, _, close in near_parts(x, y):
            n[i] += close.sum(axis=1)
        return pd.DataFrame({"id": x["id"].to_numpy(), "n": n})

    pairs = lambda a, b, meet, schema: chunk_pairs(a, b, meet, schema, chunk, ("cell",))
    near = pairs(visitors, residents, count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    core_ids = stage(near.filter(F.col("n") >= least).select("id"), "core_ids")
    cores = residents.join(core_ids, "id", "left_semi")

    def connect(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        a, b = x["id"].to_numpy(), y["id"].to_numpy()
        edges, up = [], {}

        def root(k: int) -> int:
            while up.get(k, k) != k:
                up[k] = k = up.get(up[k], up[k])
            return k

        for i, j, close in near_parts(x, y):
            left, right = close.any(axis=1), np.ones(len(j), bool)
            for start in np.flatnonzero(left):
                if not left[start]:
                    continue
                left[start], front = False, [(True, start)]
                while front:
                    on_left, k = front.pop()
                    new = np.flatnonzero((close[k] & right) if on_left else (close[:, k] & left))
                    (right if on_left else left)[new] = False
                    front += [(not on_left, n) for n in new]
                    for n in new:
                        p, q = (i[k], j[n]) if on_left else (i[n], j[k])
                        one, other = root(int(a[p])), root(int(b[q]))
                        if one != other:
                            up[one] = other
                            edges.append((int(a[p]), int(b[q])))
        return pd.DataFrame(edges, columns=["a", "b"])

    joined = connected_components(pairs(visitors.join(core_ids, "id", "left_semi"), cores, connect, "a long, b long"))
    core_clusters = core_ids.join(joined.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))

    def smallest(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        ids, none = y["id"].to_numpy(), np.iinfo(np.int64).max
        best = np.full(len(x), none)
        for i, j, close in near_parts(x, y):
            best[i] = np.minimum(best[i], np.where(close, ids[j], none).min(axis=1))
        return pd.DataFrame({"id": x["id"].to_numpy(), "core": best})[best < none]

    rest = visitors.join(core_ids, "id", "left_anti")
    border = pairs(rest, cores, smallest, "id long, core long").groupBy("id").agg(F.min("core").alias("core"))
    named = border.join(core_clusters.select(F.col("id").alias("core"), "cluster"), "core").select("id", "cluster").unionByName(core_clusters)
    return unit.select("id").join(named, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def ward_depths(vectors: np.ndarray) -> np.ndarray:
    """The depth of each row in the tree that merging the two clusters of least variance growth builds; found by chains of nearest neighbours."""
    n = len(vectors)
    if n < 2:
        return np.zeros(n, dtype=int)
    centre, size = np.vstack([vectors, np.zeros((n - 1, vectors.shape[1]))]), np.concatenate([np.ones(n), np.zeros(n - 1)])
    alive = np.concatenate([np.ones(n, bool), np.zeros(n - 1, bool)])
    parent, new, chain = np.full(2 * n - 1, -1), n, []
    while new < 2 * n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            k = chain[-1]
            others = np.flatnonzero(alive)
            others = others[others != k]
            cost = size[k] * size[others] / (size[k] + size[others]) * ((centre[others] - centre[k]) ** 2).sum(axis=1)
            best = cost.min()
            before = chain[-2] if len(chain) > 1 else -1
            j = before if before >= 0 and cost[others == before][0] <= best else int(others[cost.argmin()])
            if j == before:
                break
            chain.append(j)
        a, b = chain.pop(), chain.pop()
        size[new] = size[a] + size[b]
        centre[new] = (size[a] * centre[a] + size[b] * centre[b]) / size[new]
        alive[[a, b]], alive[new] = False, True
        parent[[a, b]] = new
        new += 1
    depth = np.zeros(2 * n - 1, dtype=int)
    for k in range(2 * n - 3, -1, -1):
        depth[k] = depth[parent[k]] + 1
    return depth[:n]


#: Rows that stand for the parts of a cluster in one round of splitting.
PIVOTS = 64


def split_clusters(df: DataFrame, most: int = 5000, seed: int = 7) -> DataFrame:
    """df (id, cluster, v) with every cluster of more than ``most`` rows split until none is larger; a part is named by its smallest id, other clusters keep their names.

    Clustering a part again with the same bounds gives the same part, so parts are made by nearness:
    each row of a large cluster goes to the nearest (largest inner product, the first of equals) of up
    to PIVOTS of its rows, and again while a part is too large. What nearness doesn't split, such as
    copies, is dealt by a hash of the id. Rows without a cluster (-1) are split like any cluster.
    A round's table is written in the shared folder; a cluster's rows meet in no task.
    """
    now, turn = stage(df.select("id", "cluster", "v"), "clusters"), 0
    while True:
        sizes = now.groupBy("cluster").agg(F.count("*").alias("n")).filter(F.col("n") > most)
        large = stage(sizes.select("cluster", "n", F.least(F.lit(PIVOTS), F.ceil(2 * F.col("n") / most)).cast("int").alias("m")), "large")
        if not large.head(1):
            return now
        turn += 1
        rows = now.join(small(large), "cluster")
        first = F.row_number().over(W.Window.partitionBy("cluster").orderBy(F.xxhash64("id", F.lit(seed + turn)), "id"))
        heads = rows.withColumn("r", first).filter(F.col("r") <= PIVOTS).filter(F.col("r") <= F.col("m"))
        heads = stage(heads.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda x: x["v"]).alias("heads")), "heads")
        # the row's own vector beside each head, so that the lambda takes nothing from outside
        beside = F.zip_with("heads", F.array_repeat("v", F.size("heads")), lambda h, v: F.round(A.dot(h, v), 12))
        placed = rows.join(small(heads), "cluster").withColumn("near", beside)
        placed = stage(placed.select("id", "cluster", "v", "n", F.array_position("near", F.array_max("near")).cast("int").alias("part")), "parts")
        whole = placed.groupBy("cluster").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low = high").select("cluster", F.lit(True).alias("whole"))
        dealt = F.pmod(F.xxhash64("id", F.lit(seed)), F.ceil(F.col("n") / most) + 1).cast("int")
        placed = placed.join(small(stage(whole, "whole")), "cluster", "left").withColumn("part", F.when(F.col("whole"), dealt).otherwise(F.col("part")))
        names = stage(placed.groupBy("cluster", "part").agg(F.min("id").alias("name")), "names")
        parts = placed.join(small(names), ["cluster", "part"]).select("id", F.col("name").cast("long").alias("cluster"), "v")
        kept = now.join(small(large), "cluster", "left_anti").select("id", F.col("cluster").cast("long").alias("cluster"), "v")
        before, now = now, stage(kept.unionByName(parts), "clusters")
        release(before)


def cluster_depths(df: DataFrame, most: int = 5000) -> DataFrame:
    """(id, cluster, depth) of each row in its cluster's tree; df has id, cluster and v.

    The tree costs the square of a cluster's size, so clusters of more than ``most`` rows are split
    before (split_clusters), and the cluster is then that of the part.
    """

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", ignore_index=True)
        return pd.DataFrame({"id": part["id"], "cluster": part["cluster"], "depth": ward_depths(_matrix(part["v"]))})

    return split_clusters(df, most).groupBy("cluster").applyInPandas(walk, "id long, cluster long, depth long")


def layers(df: DataFrame, group: str, depth: str, ratio: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    """df with layer 4, 5 or 6: how many of the group's depth thresholds a row's depth exceeds; 6 where a group has one row.

    Threshold i is the sorted depth at int(c n / total) - 1, c being the sum of the first parts of the
    ratio; index -1 is the last.
    """
    total, sums = sum(ratio), [sum(ratio[: k + 1]) for k in range(len(ratio) - 1)]
    by = W.Window.partitionBy(group)
    rows = df.withColumn("_r", F.row_number().over(by.orderBy(depth)) - 1).withColumn("_n", F.count("*").over(by))
    layer = F.lit(4)
    for c in sums:
        at = F.floor(F.lit(c) * F.col("_n") / total) - 1
        threshold = F.max(F.when(F.col("_r") == F.when(at < 0, F.col("_n") - 1).otherwise(at), F.col(depth))).over(by)
        layer = layer + F.when(F.col(depth) > threshold, 1).otherwise(0)
    return rows.withColumn("layer", F.when(F.col("_n") < 2, 6).otherwise(layer)).drop("_r", "_n")
