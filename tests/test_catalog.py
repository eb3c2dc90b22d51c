"""Every query of the catalogue against its SQL; the approximate and iterative ones against plain versions."""

import duckdb
import numpy as np
import pytest

from tessellex import catalog

from .conftest import SMALL

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, tables, name):
    df = QUERIES[name](spark, SMALL)
    told = tables.execute(SQL[name])
    columns = sorted(c[0] for c in told.description)
    assert columns == sorted(df.columns)
    at = [[c[0] for c in told.description].index(c) for c in columns]
    expected = sorted((tuple(plain(r[k]) for k in at) for r in told.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == expected


def test_names_agree():
    assert set(SQL) <= set(QUERIES) and catalog.FLAGSHIP in QUERIES


def test_ward_depths_of_a_known_tree():
    from tessellex.operators.hierarchy import ward_depths

    # 0 and 1 merge first, then 2 and 3, then both; 100 joins last
    assert ward_depths(np.array([[0.0], [1.0], [10.0], [12.0], [100.0]])).tolist() == [3, 3, 3, 3, 1]
    assert ward_depths(np.array([[1.0]])).tolist() == [0]

    def naive(x):
        parts = [[k] for k in range(len(x))]
        depth = np.zeros(len(x), dtype=int)
        while len(parts) > 1:
            def cost(a, b):
                return len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(axis=0) - x[b].mean(axis=0)) ** 2).sum()

            _, i, j = min((cost(parts[i], parts[j]), i, j) for i in range(len(parts)) for j in range(i))
            merged = parts[i] + parts[j]
            depth[merged] += 1
            parts = [p for k, p in enumerate(parts) if k not in (i, j)] + [merged]
        return depth

    x = np.random.default_rng(1).standard_normal((40, 3))
    assert ward_depths(x).tolist() == naive(x).tolist()


def greedy_walk(rows, threshold):
    """(id, name, parent, aliases) of each taker, one row after the other."""

    def code(name):
        out = np.zeros(128)
        for c in (name or "").lower():
            out[ord(c) * 131 % 128] += 1
        return out / (np.linalg.norm(out) or 1)

    out = []
    for parent in {r[2] or "" for r in rows}:
        left = sorted((r for r in rows if (r[2] or "") == parent), key=lambda r: (-(r[3] or 0), -(r[4] or 0), r[0]))
        vectors = {r[0]: code(r[1]) for r in left}
        while left:
            head = left[0]
            near = [r for r in left if r is head or vectors[r[0]] @ vectors[head[0]] >= threshold - 1e-12]
            out.append((head[0], head[1], parent, sorted({r[1] for r in near if r[1] and r[1] != head[1]})))
            left = [r for r in left if r not in near]
    return sorted(out)


def test_greedy_dedup_by_definition(spark):
    from tessellex.operators.dedup import dedupe_exact
    from tessellex.plans.entities import _scored

    scored = _scored(lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet"))
    exact = [(r["id"], r["name"], r["parent_ipc"], r["score"], r["sim"]) for r in dedupe_exact(scored).collect()]
    found = sorted((r["id"], r["name"], r["parent_ipc"], r["aliases"].split(",") if r["aliases"] else []) for r in QUERIES["entity_dedupe_greedy"](spark, SMALL).collect())
    assert found == greedy_walk(exact, 0.9)


@pytest.mark.parametrize("chunk", [16, 1000])
def test_greedy_rounds_equal_the_walk(spark, chunk):
    from tessellex.operators.dedup import dedupe_greedy

    rnd = np.random.default_rng(8)
    rows = [(k, "".join(rnd.choice(list("abcde"), 5)) if k % 50 else None, ["hot", "b", None][min(2, int(rnd.integers(0, 8)))] if k % 3 else "hot", float(rnd.integers(0, 4)), None if k % 7 == 0 else float(rnd.integers(0, 3))) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, name string, parent_ipc string, score double, sim double").repartition(3)
    found = sorted(tuple(r) for r in dedupe_greedy(df, 0.85, chunk=chunk).select("id", "name", "parent_ipc", "aliases").collect())
    assert [(a, b, c, list(d)) for a, b, c, d in found] == greedy_walk(rows, 0.85)
    assert dedupe_greedy(df.limit(0)).collect() == []


def test_split_of_edge_cases(spark):
    from pyspark.sql import functions as F

    from tessellex.operators.sampling import group_split

    rows = [(k, f"e{k % 20}", False) for k in range(200)] + [(200 + k, "unknown_entity", k < 10) for k in range(30)] + [(300, None, True), (301, "", False), (None, "unknown_entity", None)]
    got = group_split(spark.createDataFrame(rows, "k long, g string, tagged boolean"), "g", "k", F.col("tagged")).collect()
    assert len(got) == len(rows) and {r["split"] for r in got if not r["g"]} == {"train"}
    groups = {g: {r["split"] for r in got if r["g"] == g} for g in {r["g"] for r in got if r["g"] and r["g"].startswith("e")}}
    assert all(len(s) == 1 for s in groups.values()) and sorted(s for x in groups.values() for s in x) == ["test"] * 2 + ["train"] * 16 + ["valid"] * 2
    assert [sorted(r["split"] for r in got if r["g"] == "unknown_entity" and bool(r["tagged"]) is t).count("train") for t in (True, False)] == [8, 16]
    assert group_split(spark.createDataFrame([], "k long, g string, tagged boolean"), "g", "k", F.col("tagged")).collect() == []


def test_reduced_vectors_are_principal_directions(spark):
    from tessellex.operators.similarity import reduced

    x = np.random.default_rng(3).standard_normal((60, 5)) * [5, 1, 3, 1, 1]
    got = {r["id"]: r["v"] for r in reduced(spark.createDataFrame([(k, list(map(float, v))) for k, v in enumerate(x)], "id long, v array<double>"), 2).collect()}
    values, axes = np.linalg.eigh(np.cov(x.T))
    axes = axes[:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), [0, 1]])
    assert np.allclose([got[k] for k in range(60)], x @ axes)


def test_static_stage_merges_near_names(spark):
    from pyspark.sql import functions as F

    from tessellex.plans.pipelines import static_stage

    kept = spark.createDataFrame([("A01", 1, 1, "seed", None, 1.0), ("A01", 3, 2, "solar cell", "x", 3.0), ("A01", 3, 3, "Solar cells", "x", 2.0), ("B01", 3, 4, "solar cell", None, None), ("B01", 3, 5, "left out", "", 0.0)], "ipc string, level int, id long, name string, text string, score double")
    listed = spark.createDataFrame([(-1, "by hand", "", 2, "")], "id long, name string, text string, level int, ent_ipc string")
    encode = lambda c: F.array(F.lit(1.0), F.length(c).cast("double"))
    simple, near = ({(r["id"], r["name"], r["level"], tuple(r["codes"]), r["parent"]) for r in static_stage(kept, listed, F.col("name") != "left out", encode, similar=s).collect()} for s in (None, 0.9))
    seeds = {(1, "seed", 2, ("A01",), None), (-1, "by hand", 2, ("",), None)}
    assert simple == seeds | {(2, "solar cell", 3, ("A01", "B01"), 1), (3, "Solar cells", 3, ("A01",), 1)}
    assert near == seeds | {(2, "solar cell", 3, ("A01",), 1), (4, "solar cell", 3, ("B01",), None)}


def test_hierarchy_has_layers_and_parents(spark):
    rows = QUERIES["hierarchy_pipeline"](spark, SMALL).collect()
    assert {r["layer"] for r in rows} <= {4, 5, 6} and all(1 <= len(r["parent"].split(";")) <= 5 * 4 for r in rows if r["parent"])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_learned_tags_are_mostly_right_where_not_seen(spark):
    rows = [r for r in QUERIES["learned_tags"](spark, SMALL).collect() if r["held_out"]]
    assert sum(r["n"] for r in rows if r["truth"] == r["told"]) > 0.9 * sum(r["n"] for r in rows)
