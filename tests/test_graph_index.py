"""The neighbour graph: recall and the share of rows it computes, awkward tables, the query."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tessellex.operators import graph_index
from tessellex.session import prepare

from .conftest import SMALL


def table(spark, x, ids=None):
    ids = np.arange(len(x)) if ids is None else ids
    return spark.createDataFrame(pd.DataFrame({"id": ids, "v": [list(map(float, r)) for r in x]}), "id long, v array<double>")


def test_clustered_rows_are_found_with_few_products(spark, tmp_path):
    prepare(spark)
    rnd = np.random.default_rng(0)
    n, clusters, width = 6000, 60, 24
    x = rnd.standard_normal((clusters, width))[rnd.integers(0, clusters, n)] * rnd.uniform(0.8, 1.2, (n, 1)) + 0.4 * rnd.standard_normal((n, width))
    df = table(spark, x)
    graph_index.build(df, f"{tmp_path}/graph")
    stored = spark.read.parquet(f"{tmp_path}/graph")
    sizes = {r["level"]: r["count"] for r in stored.groupBy("level").count().collect()}
    assert sizes[0] == n and sorted(sizes) == list(range(len(sizes))) and sizes[max(sizes)] <= graph_index.TOP
    assert stored.agg(F.max(F.size("neighbours"))).first()[0] <= 32
    found = graph_index.search(df.filter("id % 60 = 0"), f"{tmp_path}/graph", 10, beam=24).collect()
    hits = computed = 0
    for i in range(0, n, 60):
        own = [r for r in found if r["id"] == i]
        scores = x @ x[i]
        scores[i] = -np.inf
        hits += len({r["other"] for r in own} & set(np.argsort(-scores)[:10].tolist()))
        assert sorted(r["rank"] for r in own) == list(range(1, 11))
        assert all(r["score"] == pytest.approx(scores[r["other"]], abs=1e-4) for r in own)
        computed += own[0]["computed"]
    assert hits >= 0.9 * n // 60 * 10 and computed <= 0.1 * n * (n // 60)


def test_copies_and_few_rows(spark, tmp_path):
    prepare(spark)
    for name, x in (("copies", np.ones((700, 3))), ("few", np.eye(3)), ("one", np.ones((1, 2))), ("zero", np.zeros((5, 2)))):
        df = table(spark, x)
        graph_index.build(df, f"{tmp_path}/{name}")
        found = graph_index.search(df, f"{tmp_path}/{name}", 2, beam=8)
        rows = found.collect()
        assert len(rows) == len(x) * min(2, len(x) - 1) and all(r["id"] != r["other"] for r in rows)
    graph_index.build(df.limit(0), f"{tmp_path}/empty")
    assert graph_index.search(df.limit(0), f"{tmp_path}/empty", 2).collect() == []
    assert graph_index.search(df.limit(0), f"{tmp_path}/few", 2).count() == 0


def test_query_finds_nine_in_ten(spark):
    exact = {(r["id"], r["other"]) for r in queries()["knn_exact"](spark, SMALL).collect()}
    found = {(r["id"], r["other"]) for r in queries()["knn_graph"](spark, SMALL).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
