"""Attention and pooling against a plain loop."""

import numpy as np
import pytest

from tessellex.operators import attention
from tessellex.session import prepare


def test_attention_and_pooling_equal_a_loop(spark):
    prepare(spark)
    rnd = np.random.default_rng(16)
    weights, target, source, pool = rnd.standard_normal((4, 3)), rnd.standard_normal(3), rnd.standard_normal(3), rnd.standard_normal(3)
    nodes = {(g, k): 5 * rnd.standard_normal(4) for g in "ab" for k in range(7 if g == "a" else 1)}
    edges = [("a", 0, k) for k in range(1, 7)] + [("a", k, 0) for k in range(1, 7)] + [("a", 0, 3), ("a", 2, 2)]
    df = spark.createDataFrame([(g, k, v.tolist()) for (g, k), v in nodes.items()], "graph string, node long, v array<double>").repartition(3)
    links = spark.createDataFrame(edges, "graph string, source long, target long")
    found = attention.attended(df, links, weights, target, source)
    h = {n: v @ weights for n, v in nodes.items()}
    expected = {}
    for g, k in nodes:
        near = sorted({(g, s) for x, s, t in edges if x == g and t == k} | {(g, k)})
        e = np.array([h[g, k] @ target + h[n] @ source for n in near])
        e = np.exp(np.where(e > 0, e, 0.2 * e))
        expected[g, k] = (e / e.sum()) @ np.stack([h[n] for n in near])
    rows = {(r["graph"], r["node"]): r["v"] for r in found.collect()}
    assert set(rows) == set(expected) and all(rows[n] == pytest.approx(expected[n].tolist()) for n in rows)
    kept = {(r["graph"], r["node"]): r["v"] for r in attention.pooled(found, pool, 0.5).collect()}
    score = {n: v @ pool / np.linalg.norm(pool) for n, v in expected.items()}
    best = sorted((n for n in expected if n[0] == "a"), key=lambda n: -score[n])[:4] + [("b", 0)]
    assert set(kept) == set(best) and all(kept[n] == pytest.approx((expected[n] * np.tanh(score[n])).tolist()) for n in best)
    assert attention.attended(df.limit(0), links.limit(0), weights, target, source).collect() == []
