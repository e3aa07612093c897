"""G1-G5 waves, M1-M19 functions and formula columns, U1 registry."""

import math

import pytest
from pyspark.sql import functions as F

from tagloom.functions import math as M
from tagloom.functions import registry as REG
from tagloom.functions.formula import formula_columns, resolve
from tagloom.operators import series as S
from tagloom.sources import generate as G


def _py_wave(kind, i, A, period, phase, ct):
    P = period / ct
    if kind == "sine":
        return A * math.sin(2 * math.pi * (i % P) / P + phase)
    pos = ((i % P) / P + phase) % 1.0
    if kind == "square":
        return A if pos < 0.5 else -A
    return -A + 4 * A * pos if pos < 0.5 else A - 4 * A * (pos - 0.5)


@pytest.mark.parametrize("kind", ["sine", "square", "triangle"])
@pytest.mark.parametrize("phase", [0.0, 0.3, -0.1])
def test_waves_match_python(spark, kind, phase):
    idx = spark.range(200).withColumnRenamed("id", "i")
    col = {"sine": G.sine, "square": G.square, "triangle": G.triangle}[kind]("i", 3.5, 7.3, phase, 0.5)
    got = [r.o for r in idx.select(col.alias("o")).orderBy(F.monotonically_increasing_id()).collect()]
    exp = [_py_wave(kind, i, 3.5, 7.3, phase, 0.5) for i in range(200)]
    assert got == pytest.approx(exp, abs=1e-12)


def test_list_wave(spark):
    wl = [(10, 5), (20, 3), (0, 2), (7, 0.1)]
    got = [r.o for r in spark.range(45).select(G.list_wave("id", wl, 0.5).alias("o")).collect()]
    seq = [10.0] * 10 + [20.0] * 6 + [0.0] * 4 + [7.0]
    assert got == [seq[i % len(seq)] for i in range(45)]
    for bad in ([], [(1,)], [(1, 0)], "x"):
        with pytest.raises(ValueError):
            G.list_segments(bad, 0.5)


def test_generate_dataset(spark):
    waves = {"sin1": G.Wave("sine"), "lw": G.Wave("list", wave_list=((1.0, 1.0),))}
    df = G.generate(spark, 30, waves, cycle_time=0.5, start_time=0.0, sample_interval=5.0, time_format="%Y-%m-%d %H:%M:%S")
    rows = df.orderBy("cycle_count").collect()
    assert [r.cycle_count for r in rows] == list(range(1, 31))
    assert [r.need_sample for r in rows].count(True) == 3
    assert rows[0].sim_time == 0.5 and rows[0].time_str == "1970-01-01 00:00:00"
    assert "sin1.amplitude" in df.columns and rows[0]["sin1.out"] == 0.0
    with pytest.raises(ValueError):
        G.generate(spark, 0, waves)


def test_math_domains(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (2.0,), (float("nan"),), (1e300,)], "x double")
    r = df.select(
        M.sqrt("x").alias("sq"), M.log("x").alias("ln"), M.floor("x").alias("fl"), M.pymod("x", 3).alias("md"), M.floordiv("x", 3).alias("fd"), M.min_("x", 1.0).alias("mn")
    ).collect()
    assert math.isnan(r[0].sq) and r[0].ln is None and r[0].md == 2.0 and r[0].fd == -1.0
    assert r[2].fl == 2.0 and math.isnan(r[3].fl) and r[4].fl == 1e300
    assert r[0].mn == -1.0
    with pytest.raises(Exception):
        df.select(M.sqrt("x", strict=True)).collect()
    with pytest.raises(Exception):
        df.select(M.log("x", strict=True)).collect()
    assert df.filter("x = 2").select(M.log("x", 2).alias("l")).first().l == 1.0


def test_formula_order_and_forward_reference(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(6)], "k string, c long, `sin1.out` double")
    spec = S.series_spec(df, ["k"], ["c"], chunk_size=2)
    out = formula_columns(df, [("y", "sin1 * 2"), ("z", "y + `sin1[-2]`")], spec=spec, lags={"sin1": [2]}).orderBy("c").collect()
    assert [r.z for r in out] == [0.0, 2.0, 4.0 + 0.0, 6.0 + 1.0, 8.0 + 2.0, 10.0 + 3.0]
    assert resolve(df, "sin1") == "sin1.out"
    with pytest.raises(ValueError):
        formula_columns(df, [("y", "z + 1"), ("z", "2")])


def test_register_function(spark):
    b = REG.register_function("double_it", lambda x: 2 * x, spark=spark)
    assert spark.range(3).select(b(F.col("id").cast("double")).alias("y")).collect()[2].y == 4.0
    assert spark.sql("SELECT double_it(CAST(21 AS DOUBLE)) AS y").first().y == 42.0
    assert "sqrt" in REG.functions() and REG.program("valve").name == "VALVE"


@pytest.mark.parametrize("a,b", [(1.0, 0.1), (5.0, 0.1), (1e300, 3.0), (1e19, 3.0), (7.0, -7.0), (-7.5, 7.0), (100.0, -7.0), (0.0, 3.0)])
def test_floor_division_and_remainder_are_pythons(spark, a, b):
    from tagloom.functions import math as M

    r = spark.createDataFrame([(a, b)], "a double, b double").select(M.floordiv("a", "b").alias("q"), M.pymod("a", "b").alias("r")).first()
    assert (r.q, r.r) == (a // b, a % b)
