"""Sums that do not depend on the partitioning: equal to ``math.fsum`` to the last bit."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tagloom.functions import exact
from tagloom.operators import query as Q
from tagloom.operators import series as S
from tagloom.operators import splits
from tagloom.sources.history import events_history

SF = "/root/testdata/sf0.001"


def _values(rng, n, kind):
    if kind == "plain":
        return [rng.uniform(-1000, 1000) for _ in range(n)]
    if kind == "wide":
        return [math.ldexp(rng.uniform(-1, 1), rng.randint(-1070, 1015)) for _ in range(n)]
    if kind == "cancel":
        half = [math.ldexp(rng.random(), rng.randint(-60, 60)) for _ in range(n // 2)]
        return half + [-x for x in reversed(half)] + [5e-324]
    return [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1.7976931348623157e308, 2.0**32, 2.0**32 - 2.0**-20, 2.0**-33, 1.0, 0.1] * 3


def nearest(values, n=1):
    total = sum(map(Fraction, values)) / n
    try:
        return float(total)
    except OverflowError:  # as fsum, which gives up on the way already
        return math.inf if total > 0 else -math.inf


@pytest.mark.parametrize("kind", ["plain", "wide", "cancel", "edges"])
def test_sums_and_means_equal_fsum_on_any_partitioning(spark, kind):
    rng = random.Random(kind)
    rows = [(f"k{i % 3}", v) for i, v in enumerate(_values(rng, 600, kind))]
    want = {k: [v for kk, v in rows if kk == k] for k in ("k0", "k1", "k2")}
    df = spark.createDataFrame(rows + [("nulls", None), ("k0", None)], "k string, v double")
    for parts in (1, 7, 64):
        got = {r.k: (r.n, r["sum"], r["avg"]) for r in exact.exact_sums(df.repartition(parts), ["k"], F.col("v")).collect()}
        for k, vs in want.items():
            assert got[k] == (len(vs), nearest(vs), nearest(vs, len(vs))), (k, parts)
            assert kind == "edges" or got[k][1] == math.fsum(vs)
        assert got["nulls"] == (0, None, None)


def test_not_finite(spark):
    inf, nan = float("inf"), float("nan")
    groups = {"inf": [1.0, inf], "minus": [-inf, 2.0, -inf], "both": [inf, -inf], "nan": [nan, 1.0], "large": [1.7e308, 1.7e308], "small": [-1.7e308, -1.7e308]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    got = {r.k: r["sum"] for r in exact.exact_sums(df, ["k"], F.col("v")).collect()}
    assert got["inf"] == inf and got["minus"] == -inf and math.isnan(got["both"]) and math.isnan(got["nan"]) and got["large"] == inf and got["small"] == -inf


def test_statistics_do_not_depend_on_the_partitioning(spark):
    h = events_history(spark, SF)
    rows = {}
    for r in h.collect():
        rows.setdefault(r.param_name, []).append(r.param_value)
    for parts in (1, 7, 64):
        got = {r.param_name: tuple(r)[1:] for r in Q.statistics_exact(h.repartition(parts)).collect()}
        assert got == {k: (len(v), min(v), max(v), nearest(v, len(v)), math.fsum(v)) for k, v in rows.items()}


@pytest.mark.parametrize("kind", ["plain", "cancel"])
def test_integral_equals_fsum_of_every_prefix(spark, monkeypatch, kind):
    rng = random.Random(2)
    rows = [("a", i, v) for i, v in enumerate(_values(rng, 500, kind))] + [("b", i, None if i % 3 else 0.1 * i) for i in range(60)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, c long, v double")
    seen, want = {}, {}
    for k, c, v in sorted(rows, key=lambda r: r[:2]):
        seen.setdefault(k, []).append(0.0 if v is None else v)
        want[k, c] = math.fsum(seen[k])
    for parts, chunk in ((1, 10**6), (7, 90), (64, 40)):
        monkeypatch.setattr(splits, "CHUNK_ROWS", chunk)
        d = df.repartition(parts)
        got = {(r.k, r.c): r.acc for r in S.running_sum_exact(d, S.series_spec(d, ["k"], ["c"]), F.col("v"), "acc").collect()}
        assert got == want
