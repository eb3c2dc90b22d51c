import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessellex.llm import periodic_runs as runs
from tessellex.llm import queries

from .helpers import ROWS, documents


def by_definition(w, least):
    """Every stretch that a lag leaves unextended, kept if the lag is its smallest period."""
    n, out = len(w), set()
    for q in range(1, n // 2 + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and w[end] == w[end + q]:
                end += 1
            length = end - at + q
            if end > at and length >= max(least, 2 * q) and not any(all(w[i] == w[i + p] for i in range(at, at + length - p)) for p in range(1, q)):
                out.add((at, length, q))
            at = max(end, at + 1)
    return sorted(out)


def plain_lags(w, longest):
    return [0] + [sum(w[i] == w[i + q] for i in range(len(w) - q)) for q in range(1, longest + 1)]


def numbers(w):
    return runs.codes([str(x).encode() for x in w])


sequences = st.one_of(st.lists(st.integers(0, 2), max_size=70), st.builds(lambda a, b, n: (a + b * n)[:90], st.lists(st.integers(0, 3), max_size=20), st.lists(st.integers(0, 3), max_size=20), st.integers(1, 12)))


@settings(max_examples=400, deadline=None)
@given(sequences, st.sampled_from([2, 4, 12]))
def test_runs_by_definition(w, least):
    assert runs.runs(numbers(w), least) == by_definition(w, least)


@settings(max_examples=200, deadline=None)
@given(sequences)
def test_lags_by_definition(w):
    assert runs.lag_counts(numbers(w), len(w) // 2).tolist() == plain_lags(w, len(w) // 2)


def test_lags_of_frequent_and_rare_words():
    rnd = np.random.default_rng(3)
    w = np.where(rnd.random(3000) < 0.5, 0, rnd.integers(0, 900, 3000))
    assert np.bincount(numbers(w)).max() > 1000 and np.bincount(numbers(w)).min() < 8
    assert runs.lag_counts(numbers(w), 1500).tolist() == plain_lags(w.tolist(), 1500)


def test_long_loops_inside_noise():
    rnd = np.random.default_rng(4)
    loop, noise = rnd.integers(0, 50, 701), rnd.integers(100, 9000, 2000)
    w = np.concatenate([noise[:900], np.tile(loop, 5)[:3000], noise[900:], np.zeros(40, int)])
    assert runs.runs(numbers(w)) == by_definition(w.tolist(), 12)
    assert (900, 3000, 701) in runs.runs(numbers(w))


def test_very_long_texts_are_not_read_at_every_lag(monkeypatch):
    read = []
    islands = runs.islands
    monkeypatch.setattr(runs, "islands", lambda w, lag, least: read.append(lag) or islands(w, lag, least))
    assert runs.runs(np.zeros(200_000, dtype=np.int64)) == [(0, 200_000, 1)] and read == [1]
    read.clear()
    assert runs.runs(np.arange(200_000) % 1000) == [(0, 200_000, 1000)] and read == [1000]
    read.clear()
    rnd = np.random.default_rng(5)
    runs.runs(numbers(np.minimum(rnd.zipf(1.6, 20_000), 5000)))
    assert len(read) < 20_000 * 0.5 * 0.7


def test_find(spark):
    df = documents(spark, [*ROWS, (20, "a b " * 10 + "end"), (21, "x " * 11), (22, "x " * 12 + "\x0b\n y")]).withColumn("RUNS", F.lit(1))
    found = runs.find(df)
    assert [c for c in found.columns if c.lower() == "runs"] == ["runs"] and found.columns[: len(df.columns) - 1] == df.columns[:-1]
    rows = {r["doc_id"]: r for r in found.collect()}
    assert len(found.collect()) == len(ROWS) + 3
    for i in (3, 4, 5):
        assert (rows[i]["n_words"], rows[i]["runs"], rows[i]["collapsed"]) == (0, [], "")
    assert rows[6]["n_words"] == 3001 and [tuple(r) for r in rows[6]["runs"]] == [(1, 3000, 1)] and rows[6]["collapsed"] == "x" * 30_000 + " y"
    assert [tuple(r) for r in rows[20]["runs"]] == [(0, 20, 2)] and rows[20]["collapsed"] == "a b end"
    assert rows[21]["runs"] == [] and rows[22]["collapsed"] == "x y"
    assert runs.find(df.limit(0)).collect() == []


def test_looped(spark):
    rows = [(" ".join(map(str, range(20))), 30), ("a  b\tc", 31), (None, 10), ("", 20), ("a b c d", None), ("q", 4_294_967_290)]
    df = spark.createDataFrame(rows, "t string, h long")
    found = [r[0] for r in df.select(runs.looped("t", "h")).collect()]
    # h = 30: g = 3, so a = 3 and p = 1 + 17 // 6 = 3
    assert found == ["0 1 2 " + " ".join(str(3 + k % 3) for k in range(17)), "a b c", "", "", "a b c d", "q"]


@pytest.mark.parametrize("empty", [False, True])
def test_query_columns(spark, tmp_path, empty):
    docs = spark.createDataFrame([(i, None if i == 4 else "one two " * 9, i) for i in range(40)], "doc_id long, text string, start int").limit(0 if empty else 40)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.queries()["op12_periodic_runs"](spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = {r["doc_id"]: r for r in found.collect()}
    assert len(rows) == (0 if empty else 40)
    if not empty:
        assert rows[4]["n_runs"] == 0 and rows[4]["start"] is None and rows[1]["exponent_milli"] == 9000
