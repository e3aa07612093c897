"""W1-W6 windows and R1/R2 folds against sequential pure-Python oracles, with tiny chunks."""

import datetime as dt
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.functions.registry import Program, register_algorithm
from tagloom.operators import fold as R
from tagloom.operators import program as PR
from tagloom.operators import series as S
from tagloom.operators import splits
from tagloom.operators.ingest import assign_ids
from tagloom.operators.program import run_program


def _frame(spark, n=400, series=3, gaps=False, seed=1):
    rnd = random.Random(seed)
    rows = []
    for s in range(series):
        for c in range(n if s else n // 3):  # uneven series sizes
            v = rnd.uniform(-20, 120)
            if gaps and rnd.random() < 0.3:
                v = None
            rows.append((f"s{s}", c * 3 + s, v))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "k string, c long, v double")


def _series(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.k, []).append(r)
    return {k: sorted(v, key=lambda r: r.c) for k, v in out.items()}


def _spec(df, size=17):
    return S.series_spec(df, ["k"], ["c"], chunk_size=size)


@pytest.mark.parametrize("n,inclusive,initial", [(1, False, None), (3, False, None), (40, False, None), (4, True, None), (3, False, -1.0), (0, False, None)])
def test_lag(spark, n, inclusive, initial):
    df = _frame(spark)
    got = {(r.k, r.c): r.o for r in S.lag(df, _spec(df), "v", n, default=0.0, out="o", inclusive=inclusive, initial=initial).collect()}
    k = n - 1 if inclusive else n
    for key, rows in _series(df).items():
        buf = ([initial] if initial is not None else []) + [r.v for r in rows]
        off = 1 if initial is not None else 0
        for i, r in enumerate(rows):
            j = i + off - k
            exp = r.v if k <= 0 else (buf[j] if j >= 0 else 0.0)
            assert got[(key, r.c)] == exp


def test_hold_last(spark):
    df = _frame(spark, gaps=True)
    got = {(r.k, r.c): r.o for r in S.hold_last(df, _spec(df, 5), "v", initial=7.0, out="o").collect()}
    for key, rows in _series(df).items():
        last = 7.0
        for r in rows:
            last = r.v if r.v is not None else last
            assert got[(key, r.c)] == last


def test_running_sum_and_prev(spark):
    df = _frame(spark)
    spec = _spec(df, 11)
    got = {(r.k, r.c): (r.acc, r.p) for r in S.previous_value(S.running_sum(df, spec, F.col("v"), "acc"), spec, "v", default=0.0, out="p").collect()}
    for key, rows in _series(df).items():
        acc, prev = 0.0, 0.0
        for r in rows:
            acc += r.v
            assert got[(key, r.c)][0] == pytest.approx(acc, rel=1e-12, abs=1e-9)
            assert got[(key, r.c)][1] == prev
            prev = r.v


def test_pid_equals_sequential_controller(spark):
    df = _frame(spark, gaps=True).withColumn("sv", F.when(F.col("c") % 50 == 0, F.lit(60.0)))
    out = S.pid_response(df, _spec(df, 9), pv="v", sv="sv", cycle_time=0.5).collect()
    got = {(r.k, r.c): r.mv for r in out}
    for key, rows in _series(df).items():
        # the discrete controller as its formula says: gain 100/PB folded in PB, one integral, one difference
        pv, sv, area, before = 0.0, 0.0, 0.0, 0.0
        d = S.PID_DEFAULTS
        for r in rows:
            pv = pv if r.v is None else r.v
            sv = sv if r.c % 50 else 60.0
            error = sv - pv
            area += 0.5 * error
            want = d["PB"] * (error + area / d["TI"] + d["TD"] * (error - before) / 0.5)
            before = error
            assert got[(key, r.c)] == pytest.approx(float(np.clip(want, d["L"], d["H"])), abs=1e-9)


def test_clamp_nan_is_largest(spark):
    r = spark.createDataFrame([(float("nan"),), (5.0,), (-3.0,)], "x double").select(S.clamp(F.col("x"), 0.0, 1.0).alias("y")).collect()
    assert [x.y for x in r] == [1.0, 1.0, 0.0]


def _walk_seq(targets, c, lo, hi, d):
    out = []
    for t in targets:
        diff = t - c
        c = t if abs(diff) <= d else (c + d if diff > 0 else c - d)
        c = max(lo, min(hi, c))
        out.append(c)
    return out


@pytest.mark.parametrize("travel,initial", [(10.0, 0.0), (400.0, 50.0), (0.0, 0.0), (10.0, 150.0)])
def test_slew_limit_sequential(spark, travel, initial):
    df = _frame(spark, gaps=True, seed=3)
    res = R.slew_limit(df, _spec(df, 13), "v", 0.0, 100.0, full_travel_time=travel, cycle_time=0.5, initial_opening=initial, out="o").collect()
    got = {(r.k, r.c): r.o for r in res}
    d = 100.0 / travel * 0.5 if travel > 0 else math.inf
    for key, rows in _series(df).items():
        tgt, targets = initial, []
        for r in rows:
            if r.v is not None:
                tgt = max(0.0, min(100.0, r.v))
            targets.append(tgt)
        exp = _walk_seq(targets, initial, 0.0, 100.0, d)
        assert [got[(key, r.c)] for r in rows] == pytest.approx(exp, abs=1e-12)


def _targets(kind, n):
    rng = np.random.default_rng(len(kind))
    if kind == "ends":  # never brings two entries together
        return np.where(np.arange(n) % 2 == 0, 0.0, 100.0).tolist()
    return (rng.random(n) * 100 if kind == "random" else np.repeat(rng.integers(0, 101, n), 7)[:n].astype(float)).tolist()


@pytest.mark.parametrize("kind", ["ends", "random", "steps"])
@pytest.mark.parametrize("dist", [0.0, 5e-5, 0.37, 5.0, 40.0])
def test_exit_map_equals_the_steps(kind, dist):
    targets = _targets(kind, 3000)
    x, y = R.exit_map(targets, 0.0, 100.0, dist, 0.0, 120.0)
    for c in [0.0, 1e-3, 7.7, 50.0, 99.99, 100.0, 113.0, 120.0]:
        assert np.interp(c, x, y) == pytest.approx(_walk_seq(targets, c, 0.0, 100.0, dist)[-1], abs=1e-8)


@pytest.mark.parametrize("kind", ["ends", "random"])
@pytest.mark.parametrize("travel", [400.0, 1e6])
def test_slow_valves_take_few_levels(spark, monkeypatch, kind, travel):
    monkeypatch.setattr(R, "FAN", 3)
    monkeypatch.setattr(splits, "CHUNK_ROWS", 100)
    targets = _targets(kind, 2000)
    big = 9007199254740993
    schema = "k string, c long, v double, tag long"
    df = spark.createDataFrame([("hot", i, t, big if i % 2 else None) for i, t in enumerate(targets)] + [("still", i, 50.0, big) for i in range(5)], schema)
    out = R.slew_limit(df, S.series_spec(df, ["k"], ["c"]), "v", full_travel_time=travel, initial_opening=30.0, out="o")
    assert out.columns == ["k", "c", "v", "tag", "o"]
    rows = out.collect()
    got = {r.c: r for r in rows if r.k == "hot"}
    want = _walk_seq(targets, 30.0, 0.0, 100.0, 100.0 / travel * 0.5)
    assert len(rows) == 2005 and all(got[i].tag == (big if i % 2 else None) for i in got)
    assert [got[i].o for i in range(2000)] == pytest.approx(want, abs=1e-8)
    assert [r.o for r in sorted((r for r in rows if r.k == "still"), key=lambda r: r.c)] == pytest.approx(_walk_seq([50.0] * 5, 30.0, 0.0, 100.0, 100.0 / travel * 0.5))


@pytest.mark.parametrize("low, high", [(0.0, 120.0), (40.0, 41.5), (55.0, 55.0)])
def test_maps_are_built_on_the_entries_that_can_reach_them(low, high):
    targets = _targets("ends", 3000)
    x, y = R.exit_map(targets, 0.0, 100.0, 0.001, low, high)
    for c in np.linspace(low, high, 9):
        assert np.interp(c, x, y) == pytest.approx(_walk_seq(targets, c, 0.0, 100.0, 0.001)[-1], abs=1e-8)
    assert len(x) <= 4 * (high - low) / 0.001 + 4


def test_a_group_composes_few_large_maps():
    assert R.fan_for(2) == R.FAN and R.fan_for(181_140) == 5 and R.fan_for(10**9) == 2
    assert all(most * R.fan_for(most) <= max(R.KNOTS, 2 * most) for most in (2, 1000, 20_000, 300_000, 10**7))


def test_split_points_are_literals_that_follow_the_order(spark):
    rows = [(random.Random(i).choice([None, "a", "b", "ü'\\"]), [None, float("nan"), 1.5, -2.0][i % 4], i % 50 if i % 9 else None, dt.datetime(2024, 1, 1, 0, 0, i % 60, i), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "s string, d double, n long, t timestamp_ntz, id long")
    order = ["s", "d", "n", "t", "id"]
    for parts in (2, 9, 60):
        points = splits.split_points(df, order, parts)
        marked = df.withColumn("part", points.index())
        got = [r.part for r in marked.orderBy(*order).collect()]
        assert got == sorted(got) and set(got) <= set(range(parts)) and len(set(got)) == parts
        assert max(got.count(p) for p in set(got)) <= 3 * 3000 / parts + 60
        plan = marked._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan  # nothing moves for it


def test_numbering_writes_nothing(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(folder))
    out = assign_ids(df, ["k"], start=1, num_partitions=9)
    assert [r.id - r.k for r in out.collect()] == [1] * 5000 and set(os.listdir(folder)) == before


def test_step_program_carries_its_state_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(splits, "CHUNK_ROWS", 100)
    targets = [None if i % 5 == 0 else float("nan") if i % 50 == 1 else t for i, t in enumerate(_targets("random", 900))]
    df = spark.createDataFrame([("hot", i, t) for i, t in enumerate(targets)] + [("b", 0, 40.0)], "k string, c long, v double")
    spec = S.series_spec(df, ["k"], ["c"])
    out = run_program(df, spec, "valve", {"target": "v"}, {"full_travel_time": 400.0, "cycle_time": 0.5}).collect()
    want = {(r.k, r.c): r.o for r in R.slew_limit(df, spec, "v", full_travel_time=400.0, out="o").collect()}
    assert len(out) == 901 and {(r.k, r.c): r.current_opening for r in out} == pytest.approx(want, abs=1e-9)
    lagged = run_program(df, spec, "lag", {"value": "c"}, {"n": 3, "default": -1.0}, {"lagged": "bigint"}).collect()
    assert all(r.lagged == (r.c - 3 if r.c >= 3 else -1) for r in lagged)
    assert run_program(df.limit(0), spec, "lag", {"value": "c"}).collect() == []


def _smooth(a):
    """Exponential smoothing: a row's element is the affine map s -> (1 - a) s + a x."""

    def lift(row, p):
        return [1.0, 0.0] if row["x"] is None else [1 - a, a * row["x"]]

    def step(state, row, p):
        m, b = lift(row, p)
        return m * state + b, {"smooth": m * state + b}

    return Program("SMOOTH", "algorithm", step, lambda p: p["s0"], ("smooth",), {"s0": 0.0}, lift=lift, combine=lambda f, g: [f[0] * g[0], g[0] * f[1] + g[1]], act=lambda s, f: f[0] * s + f[1])


@pytest.mark.parametrize("fan", [2, 64])
def test_associative_programs_run_on_all_chunks_at_once(spark, monkeypatch, fan):
    monkeypatch.setattr(splits, "CHUNK_ROWS", 50)
    monkeypatch.setattr(PR, "FAN", fan)
    register_algorithm(_smooth(0.1))
    rng = random.Random(4)
    rows = [("hot" if i % 10 else f"k{i % 7}", i, None if i % 11 == 0 else rng.uniform(-5, 5)) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, c long, v double")
    spec = S.series_spec(df, ["k"], ["c"])
    written = []
    real = PR.materialize
    monkeypatch.setattr(PR, "materialize", lambda d, name: written.append(name) or real(d, name))
    got = {(r.k, r.c): r.smooth for r in run_program(df, spec, "smooth", {"x": "v"}, {"s0": 7.0}).collect()}
    levels = written.count("program-block") + 1
    chunks = -(-1500 // 50)
    assert levels <= math.ceil(math.log(2 * chunks, fan)) and written.count("program-before") == levels  # two rounds a level
    state = {}
    for k, c, v in rows:
        s = state.get(k, 7.0)
        state[k] = s if v is None else 0.9 * s + 0.1 * v
        assert got[(k, c)] == pytest.approx(state[k], abs=1e-9)
    assert len(got) == 1500


def test_the_integral_as_a_program(spark, monkeypatch):
    monkeypatch.setattr(splits, "CHUNK_ROWS", 100)
    df = _frame(spark, gaps=True)
    spec = S.series_spec(df, ["k"], ["c"])
    total = {(r.k, r.c): r.total for r in run_program(df, spec, "total", {"value": "v"}, {"dt": 0.25}).collect()}
    want = {(r.k, r.c): r.acc for r in S.running_sum(df, spec, F.coalesce("v", F.lit(0.0)) * 0.25, "acc").collect()}
    assert total == pytest.approx(want, abs=1e-9)
    assert run_program(df.limit(0), spec, "total", {"value": "v"}).collect() == []
    with pytest.raises(ValueError):
        Program("HALF", "algorithm", lambda *a: a, lambda p: 0, ("x",), lift=lambda r, p: 0)


def test_fold_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k string, c long, v double")
    assert R.slew_limit(df, S.series_spec(df, ["k"], ["c"]), "v", out="o").collect() == []


def _scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") + df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")


def test_scan_count_does_not_follow_the_lags(spark):
    df = _frame(spark)
    spec = S.series_spec(df, ["k"], ["c"])
    one = S.lag_many(df, spec, [("v", 1, "a")])
    four = S.lag_many(df, spec, [("v", n, f"a{n}") for n in (1, 2, 7, 40)])
    assert _scans(one) == _scans(four)


@pytest.mark.parametrize("size", [None, 3])
def test_lags_longer_than_chunks(spark, size):
    df = _frame(spark)
    spec = S.series_spec(df, ["k"], ["c"], chunk_size=size)
    got = {(r.k, r.c): (r.a, r.b, r.d) for r in S.lag_many(df, spec, [("v", 1, "a"), ("v", 2, "b"), ("v", 25, "d")], default=-1.0).collect()}
    for key, rows in _series(df).items():
        values = [r.v for r in rows]
        for i, r in enumerate(rows):
            assert got[(key, r.c)] == tuple(values[i - n] if i >= n else -1.0 for n in (1, 2, 25))


def test_chunks_are_cut_by_the_data(spark, monkeypatch):
    monkeypatch.setattr(splits, "CHUNK_ROWS", 500)
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.when(F.col("id") < 18_000, F.lit(0)).otherwise(F.col("id")).alias("day"), F.col("id").alias("c"))
    laid = S.lay_out(df, S.series_spec(df, ["k"], ["day", "c"]))
    assert laid.groupBy("k", "_chunk").count().agg(F.max("count")).first()[0] <= 1500
