"""Connected components of an undirected graph, without gathering any node's neighbours in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import release, stage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge list of longs; the component is its smallest node.

    Alternates two contractions until nothing moves: every node hands its larger neighbours to its
    smallest one, then its smaller neighbours to the smallest of them. The edges shrink to a star
    for each component in about log2(diameter) rounds. Minima are aggregated before each shuffle and
    joined back, so a node with very many neighbours is split like any skewed key. Each round is
    written in the shared folder, and deleted once the next one is. Loops, repeated edges and edges with a null end don't matter.
    """
    now = stage(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter(f"{a} is not null and {b} is not null and u <> v").distinct(), "edges")
    seen = None
    while True:
        before = now
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.filter("u > m").select("u", F.col("m").alias("v"))).distinct()
        large = stage(large, "large")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        now = stage(large.join(small, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct(), "small")
        release(before)
        release(large)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
