"""Attention over graphs with given weights: edge scores, a softmax for each node, pooling of the best nodes; as joins and aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.staging import stage


def projected(v: Column, weights: np.ndarray) -> Column:
    """A vector times a matrix (a row for each entry of the vector)."""

    @F.pandas_udf("array<double>")
    def run(part: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(part.to_numpy()).astype(float) @ weights)) if len(part) else pd.Series([], dtype=object)

    return run(v)


def attended(nodes: DataFrame, edges: DataFrame, weights: np.ndarray, target: np.ndarray, source: np.ndarray, slope: float = 0.2) -> DataFrame:
    """(graph, node, v): each node's mean of its sources' projected vectors, weighted by a softmax of edge scores.

    nodes has graph, node and v; edges has graph, source and target, every node is a source of its own too, and
    repeated edges count once. An edge's score is the leaky rectified sum of the target's product with
    ``target`` and the source's with ``source``, both after the projection. A node's greatest score is taken off
    before exponents are, and its mean is aggregated before rows are shuffled, so a centre of very many
    neighbours is gathered nowhere.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    own = stage(nodes.select("graph", "node", projected(F.col("v"), weights).alias("h")), "projected")
    told = lambda a: F.aggregate(F.zip_with("h", F.array(*map(F.lit, a.tolist())), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    loops = own.select("graph", F.col("node").alias("source"), F.col("node").alias("target"))
    every = edges.select("graph", "source", "target").unionByName(loops).distinct()
    left = own.select("graph", F.col("node").alias("target"), told(target).alias("t"))
    right = own.select("graph", F.col("node").alias("source"), told(source).alias("s"), "h")
    score = F.col("t") + F.col("s")
    scored = stage(every.join(left, ["graph", "target"]).join(right, ["graph", "source"]).select("graph", F.col("target").alias("node"), F.when(score > 0, score).otherwise(slope * score).alias("score"), "h"), "scores")
    most = scored.groupBy("graph", "node").agg(F.max("score").alias("most"))
    weighted = scored.join(most, ["graph", "node"]).withColumn("w", F.exp(F.col("score") - F.col("most")))
    mean = weighted.groupBy("graph", "node").agg(Summarizer.mean(array_to_vector("h"), F.col("w")).alias("v"))
    return mean.select("graph", "node", vector_to_array("v").alias("v"))


def pooled(nodes: DataFrame, weights: np.ndarray, ratio: float = 0.5) -> DataFrame:
    """(graph, node, v): of each graph the ceil(ratio n) nodes of the largest score, ties to the smaller node, their vectors times the score's hyperbolic tangent.

    A node's score is its product with the weights over their length, rounded to 12 places.
    """
    unit = (weights / np.linalg.norm(weights)).tolist()
    score = F.aggregate(F.zip_with("v", F.array(*map(F.lit, unit)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    rows = nodes.withColumn("score", F.round(score, 12))
    sizes = rows.groupBy("graph").agg(F.ceil(F.count("*") * ratio).alias("keep"))
    ranked = rows.withColumn("place", F.row_number().over(W.Window.partitionBy("graph").orderBy(F.desc("score"), "node"))).join(sizes, "graph").filter(F.col("place") <= F.col("keep"))
    gated = F.zip_with("v", F.array_repeat(F.tanh("score"), F.size("v")), lambda x, g: x * g)
    return ranked.select("graph", "node", gated.alias("v"))
