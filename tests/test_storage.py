"""S1/S10 layout on disk, rollups, and what a query reads of them."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tagloom.operators import query as Q
from tagloom.schema import HISTORY_SCHEMA
from tagloom.sources import history as H
from tagloom.sources import rollup as RU

DAY = dt.datetime(2024, 5, 1)


def scanned(df, metric="numOutputRows"):
    """A metric of the scan of a plan without shuffles, after running it."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return plan.collectLeaves().head().metrics().apply(metric).value()


def dense_day(spark, n=32_000, tags=64):
    rows = [(i, DAY + dt.timedelta(microseconds=i * (86_400_000_000 // n)), f"inst{i * 7919 % tags:02d}.v", float(i), f"inst{i * 7919 % tags:02d}", "variable", i, 0.0) for i in range(n)]
    return spark.createDataFrame(rows, HISTORY_SCHEMA).coalesce(1)


def test_curve_skips_row_groups_by_tag_and_by_time(spark, tmp_path):
    day, n = dense_day(spark), 32_000
    read = {}
    for cluster in ("tag", "curve", None):
        path = str(tmp_path / str(cluster))
        if cluster:
            H.write_history(day, path, cluster=cluster, group_rows=500)
        else:  # as it arrives
            day.withColumn("date", F.to_date("timestamp")).write.partitionBy("date").option("parquet.block.row.count.limit", "500").parquet(path)
        h = H.read_history(spark, path)
        by_tag = Q.history_filter(h, param_name="inst07.v")
        by_time = Q.history_filter(h, start_time=DAY + dt.timedelta(hours=9), end_time=DAY + dt.timedelta(hours=9, minutes=20))
        both = Q.history_filter(h, param_name="inst07.v", start_time=DAY + dt.timedelta(hours=9), end_time=DAY + dt.timedelta(hours=12))
        assert by_tag.count() == n // 64 and both.count() == sum(1 for r in by_tag.collect() if 9 <= (r.timestamp - DAY).total_seconds() / 3600 <= 12)
        read[cluster] = [scanned(q) for q in (by_tag, by_time, both)]
    assert read[None][0] == n and read["tag"][1] >= n // 2  # neither order serves both
    assert read["curve"][0] <= n // 4 and read["curve"][1] <= n // 4 and read["curve"][2] <= n // 8
    assert read["tag"][0] <= n // 16


def test_bloom_filter_skips_groups_that_lack_a_tag(spark, tmp_path):
    """More tags than a dictionary page holds: the filter tells that a tag within the bounds is not there."""
    rng = random.Random(3)
    tags = [f"{rng.getrandbits(64):016x}" * 4 + ".v" for _ in range(30_000)]
    rows = [(i, DAY, t, 1.0, t[:-2], "variable", i, 0.0) for i, t in enumerate(tags)]
    df = spark.createDataFrame(rows, HISTORY_SCHEMA).coalesce(1)
    H.write_history(df, str(tmp_path / "bloom"), tags=40_000)
    df.withColumn("date", F.to_date("timestamp")).write.partitionBy("date").parquet(str(tmp_path / "plain"))
    absent = Q.history_filter(H.read_history(spark, str(tmp_path / "bloom")), param_name="8" * 64 + ".v")
    there = Q.history_filter(H.read_history(spark, str(tmp_path / "bloom")), param_name=tags[5])
    plain = Q.history_filter(H.read_history(spark, str(tmp_path / "plain")), param_name="8" * 64 + ".v")
    assert there.count() == 1 and absent.count() == 0
    assert scanned(plain) == 30_000 and scanned(absent) < 30_000


def test_unknown_cluster(spark, tmp_path):
    with pytest.raises(ValueError):
        H.write_history(dense_day(spark, 10), str(tmp_path / "x"), cluster="hilbert")


def _stored(spark, path, days=20, batches=3):
    rng = random.Random(9)
    rows = [(None, DAY + dt.timedelta(hours=rng.randrange(24 * days), minutes=rng.randrange(60)), f"pid{rng.randrange(3)}.mv", float(rng.randrange(100)), "", "algorithm", i, 0.0) for i in range(900)]
    rows = [(*r[:4], r[2].split(".")[0], *r[5:]) for r in rows]
    cut = [rows[i::batches] for i in range(batches)]
    for part in cut:
        H.append_history(spark.createDataFrame([r[1:] for r in part], "timestamp timestamp_ntz, param_name string, param_value double, instance_name string, param_type string, cycle_count int, sim_time double"), path)
    return H.read_history(spark, path)


def _plain(h, start=None, end=None):
    return {tuple(r) for r in Q.statistics_by_tag(h, start, end).select("param_name", "count", "min", "max", "avg", "sum").collect()}


RANGES = [(None, None), ("2024-05-03T00:00:00", None), ("2024-05-03T07:30:00", "2024-05-15T12:00:00"), (None, "2024-05-15T12:00:00"), ("2024-05-04T01:00:00", "2024-05-04T23:00:00"), ("2030-01-01", None)]


def test_rollup_equals_the_rows_and_reads_edge_days_only(spark, tmp_path):
    path = str(tmp_path / "h")
    h = _stored(spark, path)
    for start, end in RANGES:
        assert {tuple(r) for r in RU.statistics_rollup(spark, path, start, end).collect()} == _plain(h, start, end), (start, end)
    assert sorted(map(tuple, RU.latest_rollup(spark, path).collect())) == sorted(map(tuple, Q.latest_values(h).collect()))
    assert sorted(map(tuple, RU.latest_rollup(spark, path, "pid1").collect())) == sorted(map(tuple, Q.latest_values(h, "pid1").collect()))
    edges = RU.range_partials(spark, path, "2024-05-03T07:30:00", "2024-05-15T12:00:00")
    plan = edges._jdf.queryExecution().executedPlan().toString()
    days = [line for line in plan.split("\n") if "date IN (2024-05-03,2024-05-15)" in line or "date#" in line and "IN (" in line]
    assert days and "param_value" not in str(RU.range_partials(spark, path)._jdf.queryExecution().executedPlan())


def test_a_batch_without_its_rollup_is_read_from_its_rows(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "h")
    _stored(spark, path, batches=2)
    with monkeypatch.context() as m:
        m.setattr(RU, "extend", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            _stored(spark, path, batches=1)
    h = H.read_history(spark, path)
    assert h.count() == 1800
    for start, end in RANGES:
        assert {tuple(r) for r in RU.statistics_rollup(spark, path, start, end).collect()} == _plain(h, start, end)
    RU.extend(spark, path)
    assert RU._missing(spark, path) == []
    assert {tuple(r) for r in RU.statistics_rollup(spark, path).collect()} == _plain(h)
    RU.rebuild(spark, path)
    assert {tuple(r) for r in RU.statistics_rollup(spark, path, *RANGES[2]).collect()} == _plain(h, *RANGES[2])


def test_a_noted_batch_whose_rows_never_came(spark, tmp_path):
    path = str(tmp_path / "h")
    h = _stored(spark, path, batches=1)
    RU.note_batch(spark, path, 901, 50)  # the append failed
    assert {tuple(r) for r in RU.statistics_rollup(spark, path).collect()} == _plain(h)
    h = _stored(spark, path, batches=1)  # takes the same ids
    assert h.count() == 1800 and {tuple(r) for r in RU.statistics_rollup(spark, path).collect()} == _plain(h)


def test_scratch_folders_are_dropped(spark):
    import os

    from tagloom.plans import catalog
    from tagloom.session import scratch

    with scratch(spark) as folder:
        rows = catalog.sampled_query(spark, "/root/testdata/sf0.001").count()
        assert rows and os.listdir(folder.removeprefix("file:"))
        with scratch(spark) as inner:
            assert catalog.program_total(spark, "/root/testdata/sf0.001").count() == 1000 and inner.startswith(folder)
        assert not os.path.exists(inner.removeprefix("file:"))
    assert not os.path.exists(folder.removeprefix("file:"))
