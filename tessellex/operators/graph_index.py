"""A neighbour graph over vectors, stored in levels and searched with a bounded beam."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import arrays as A
from ..functions.staging import release, stage
from .ids import dense_ids
from .similarity import _matrix, blocked_top

#: Rows that the top level has at most, and how many rows one row of the next level stands for.
TOP, STEP = 256, 16
#: Rows that are compared with each other at first, in each of several orders; nodes that one task call joins.
WINDOW, NODES = 256, 256
STORED = "id long, v array<float>, neighbours array<long>, level int"
#: Signs of projections that an order begins with.
BITS = 12


def build(df: DataFrame, path: str, degree: int = 16, orders: int = 3, rounds: int = 2, seed: int = 7) -> None:
    """Write the graph of df (id, v) under ``path``: (level, id, v, neighbours), a folder for each level.

    Vectors get one more dimension, so that all have one length and the largest inner product is the
    nearest. Level 0 has every row; each next level has those of the one below whose hash falls to
    them, one in STEP, until TOP rows are left. Ids are unique; vectors have one length, without nulls.

    A level's graph begins with the ``degree`` best of each row among WINDOW rows beside it, in
    ``orders`` orders by random projections, cut into ranges of equal size whatever the data. Then, in each
    of ``rounds`` rounds, the neighbours of every node, in both directions, are compared with each
    other, and each keeps the best it met: a neighbour's neighbour is likely a neighbour. What a node
    joins is bounded (its degree in either direction), so a node that is near to very many costs no
    more than any other. Each round is written in the shared folder. What is stored has the reverse
    neighbours too, the nearest ``degree`` of them.
    """
    largest = df.agg(F.max(A.dot(F.col("v"), F.col("v")))).first()[0] or 0.0
    rest = F.sqrt(F.greatest(F.lit(0.0), F.lit(largest) - A.dot(F.col("v"), F.col("v"))))
    rows = stage(df.select("id", F.concat("v", F.array(rest)).cast("array<float>").alias("v")), "vectors")
    place = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40))
    level, n = 0, rows.count()
    while True:
        here = rows.filter(F.pmod(place, F.lit(STEP**level)) == 0)
        top = n <= TOP
        found = here.withColumn("neighbours", F.array().cast("array<long>")) if top else here.join(_neighbours(stage(here, "level"), n, degree, orders, rounds, seed + level), "id")
        found.select(F.lit(level).alias("level"), "id", "v", "neighbours").write.mode("append").partitionBy("level").parquet(path)
        if top:
            break
        level += 1
        n = rows.filter(F.pmod(place, F.lit(STEP**level)) == 0).count()
    release(rows)


def _neighbours(rows: DataFrame, n: int, degree: int, orders: int, rounds: int, seed: int) -> DataFrame:
    """(id, neighbours) of each row of a level."""
    edges = stage(_best(reduce(DataFrame.unionByName, [_in_windows(rows, degree, seed * 31 + k) for k in range(orders)]), degree), "edges")
    for _ in range(rounds):
        before, edges = edges, stage(_best(edges.unionByName(_joined(rows, edges, n, degree)), degree), "edges")
        release(before)
    both = edges.select("id", "other", "score").unionByName(_best(edges.select(F.col("other").alias("id"), F.col("id").alias("other"), "score"), degree))
    return both.groupBy("id").agg(F.collect_set("other").alias("neighbours"))


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """(id, other, score): each id's k best others, once each."""
    once = pairs.groupBy("id", "other").agg(F.max("score").alias("score"))
    return once.withColumn("r", F.row_number().over(W.Window.partitionBy("id").orderBy(F.desc("score"), "other"))).filter(F.col("r") <= k).drop("r")


def _in_windows(rows: DataFrame, k: int, seed: int) -> DataFrame:
    """(id, other, score): each row's k best in its range of an order by the signs of BITS projections, then by one more."""

    @F.pandas_udf("code int, along double")
    def placed(v: pd.Series) -> pd.DataFrame:
        x = _matrix(v)
        p = x @ np.random.default_rng(seed).standard_normal((x.shape[1], BITS + 1))
        return pd.DataFrame({"code": ((p[:, :BITS] > 0) << np.arange(BITS)).sum(axis=1), "along": p[:, BITS]})

    ordered = dense_ids(rows.withColumn("p", placed("v")).select("id", "v", "p.code", "p.along"), ["code", "along", "id"], "n", 0)

    def best(part: pd.DataFrame) -> pd.DataFrame:
        ids, x = part["id"].to_numpy(), _matrix(part["v"])
        return _frame([_tops(ids, x @ x.T, k)])

    return ordered.select("id", "v", F.floor(F.col("n") / WINDOW).alias("w")).groupBy("w").applyInPandas(best, "id long, other long, score float")


def _tops(ids: np.ndarray, scores: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, others and scores of each row's k best columns but its own, above the row's floor."""
    np.fill_diagonal(scores, -np.inf)
    k = min(k, len(ids) - 1)
    at = np.argpartition(-scores, k - 1, axis=1)[:, :k] if k > 0 else np.empty((len(ids), 0), np.int64)
    best = np.take_along_axis(scores, at, axis=1)
    keep = (best > (-np.inf if floors is None else floors[:, None])).ravel()
    return np.repeat(ids, max(k, 0))[keep], ids[at].ravel()[keep], best.ravel()[keep]


def _frame(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("id", "other", "score"), map(np.concatenate, zip(*found)))))


def _joined(rows: DataFrame, edges: DataFrame, n: int, k: int) -> DataFrame:
    """(id, other, score) of neighbours of one node, better than the worst that the id has; rows meet by node, NODES of them to a call."""
    floors = edges.groupBy("id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(-1e30)).cast("float").alias("floor"))
    back = _best(edges.select(F.col("other").alias("id"), F.col("id").alias("other"), "score"), k)
    members = edges.unionByName(back).select(F.col("id").alias("node"), F.col("other").alias("id")).distinct()
    met = members.join(rows.join(floors, "id", "left"), "id").withColumn("task", F.pmod(F.xxhash64("node"), F.lit(-(-n // NODES))))

    def join(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["node", "id"], ignore_index=True)
        ids, x, floor = part["id"].to_numpy(), _matrix(part["v"]), part["floor"].fillna(-1e30).to_numpy()
        ends = np.flatnonzero(np.append(np.diff(part["node"].to_numpy()) != 0, True)) + 1
        found = [_tops(ids[a:b], x[a:b] @ x[a:b].T, k, floor[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        return _frame(found).drop_duplicates(["id", "other"])

    return met.groupBy("task").applyInPandas(join, "id long, other long, score float")


def search(queries: DataFrame, path: str, k: int, beam: int = 48, rounds: int = 12, skip_self: bool = True) -> DataFrame:
    """(id, rank, other, score, computed): about the k largest inner products of each query (id, v) among the rows of a graph that ``build`` wrote.

    All rows of the top level are compared; in each level below, the ``beam`` best so far are opened:
    rows beside one that is open and was not met yet are looked up by id and compared, until the
    beam of no query changes (or ``rounds`` are over). Queries are rows of a table that joins the stored
    graph and vectors by id in each round, so their number isn't bounded by one machine; what a query
    holds is its beam and the ids it met, and ``computed`` counts these, over all levels. Approximate.
    """
    spark = queries.sparkSession
    stored = spark.read.schema(STORED).parquet(path)
    top = stored.agg(F.max("level")).first()[0]
    if top is None:
        return spark.createDataFrame([], "id long, rank int, other long, score double, computed int")
    asked = stage(queries.select("id", F.concat("v", F.array(F.lit(0.0))).cast("array<double>").alias("v")), "queries")
    upper = stored.filter(F.col("level") == top).select("id", F.col("v").cast("array<double>").alias("v"))
    begun = blocked_top(asked.withColumn("block", F.lit(0)), upper.withColumn("block", F.lit(0)), beam, skip_self=False)
    own = begun.groupBy("id").agg(F.array_sort(F.collect_list(_entry(F.col("score"), F.col("other"), F.lit(True)))).alias("beam"))
    now = stage(own.withColumn("met", F.transform("beam", lambda b: b["other"])).withColumn("computed", F.lit(upper.count())), "beam")
    for level in range(top - 1, -1, -1):
        graph, first = stored.filter(F.col("level") == level), now
        now = stage(first.select("id", F.transform("beam", lambda b: _entry(-b["s"], b["other"], F.lit(True))).alias("beam"), F.transform("beam", lambda b: b["other"]).alias("met"), "computed"), "beam")
        release(first)
        for _ in range(rounds):
            before, now = now, stage(_opened(now, asked, graph, beam), "beam")
            release(before)
            if not now.filter(F.exists("beam", lambda b: b["open"])).head(1):
                break
    flat = now.select("id", "computed", F.explode("beam").alias("b")).select("id", "computed", F.col("b.other").alias("other"), (-F.col("b.s")).alias("score"))
    flat = flat.filter("id <> other") if skip_self else flat
    ranked = flat.withColumn("rank", F.row_number().over(W.Window.partitionBy("id").orderBy(F.desc("score"), "other")))
    return ranked.filter(F.col("rank") <= k).select("id", "rank", "other", "score", "computed")


def _entry(score: Column, other: Column, open_: Column) -> Column:
    """A place in a beam; sorted, the best comes first."""
    return F.struct((-score).alias("s"), other.alias("other"), open_.alias("open"))


def _opened(now: DataFrame, asked: DataFrame, graph: DataFrame, beam: int) -> DataFrame:
    """The beams after one round: every open place is replaced by a closed one, and what lies beside it is met."""
    opened = now.select("id", F.explode(F.filter("beam", lambda b: b["open"])).alias("b")).select(F.col("id").alias("query"), F.col("b.other").alias("id"))
    beside = opened.join(graph.select("id", "neighbours"), "id").select(F.col("query").alias("id"), F.explode("neighbours").alias("other")).groupBy("id").agg(F.collect_set("other").alias("beside"))
    fresh = now.select("id", "met").join(beside, "id").select("id", F.explode(F.array_except("beside", "met")).alias("other"))
    vectors = graph.select(F.col("id").alias("other"), F.col("v").cast("array<double>").alias("w"))
    scored = fresh.join(vectors, "other").join(asked, "id").select("id", _entry(F.round(A.dot(F.col("v"), F.col("w")), 12), F.col("other"), F.lit(True)).alias("b"))
    new = scored.groupBy("id").agg(F.collect_list("b").alias("new"))
    none = F.array().cast(now.schema["beam"].dataType)
    closed = F.transform("beam", lambda b: F.struct(b["s"].alias("s"), b["other"].alias("other"), F.lit(False).alias("open")))
    both = now.join(new, "id", "left").withColumn("new", F.coalesce("new", none))
    merged = F.slice(F.array_sort(F.concat(closed, F.col("new"))), 1, beam)
    return both.select("id", merged.alias("beam"), F.concat("met", F.transform("new", lambda b: b["other"])).alias("met"), (F.col("computed") + F.size("new")).alias("computed"))
