"""S2-S9 ingest rules and F/A history queries on literal fixtures."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tagloom.operators import ingest as I
from tagloom.operators import query as Q
from tagloom.schema import HISTORY_SCHEMA
from tagloom.sources.history import events_history, read_history, write_history


def _snapshot(spark, with_sample=True):
    cols = "`tank1.level` double, `pid1.mv` double, `pid1.pv` double, cycle_count int, sim_time double, time_str string, timestamp timestamp_ntz"
    cols += ", need_sample boolean" if with_sample else ""
    row = [50.5, 30.0, 50.5, 1, 0.5, "2024-12-06 10:00:00", dt.datetime(2024, 12, 6, 10)]
    if with_sample:
        row.append(True)
    return spark.createDataFrame([tuple(row)], cols)


def test_unpivot_snapshot(spark):
    long = I.snapshots_to_history(_snapshot(spark)).collect()
    got = sorted((r.param_name, r.param_value, r.instance_name, r.param_type, r.cycle_count, r.sim_time) for r in long)
    assert got == [
        ("pid1.mv", 30.0, "pid1", "algorithm", 1, 0.5),
        ("pid1.pv", 50.5, "pid1", "algorithm", 1, 0.5),
        ("tank1.level", 50.5, "tank1", "model", 1, 0.5),
    ]


def test_missing_need_sample_stores_nothing(spark):
    assert I.snapshots_to_history(_snapshot(spark, with_sample=False)).count() == 0
    df = _snapshot(spark).withColumn("need_sample", F.lit(None).cast("boolean"))
    assert I.snapshots_to_history(df).count() == 0


def test_allow_list_and_non_numeric_dropped(spark):
    df = _snapshot(spark).withColumn("wave_list", F.lit("[(1,2)]")).withColumn("flag", F.lit(True))
    long = I.snapshots_to_history(df, stored_variables=["pid1.mv", "wave_list", "flag"]).collect()
    assert sorted((r.param_name, r.param_value, r.instance_name) for r in long) == [("flag", 1.0, "unknown"), ("pid1.mv", 30.0, "pid1")]


@pytest.mark.parametrize(
    "tag,inst,kind",
    [
        ("rapid1.out", "rapid1", "algorithm"),
        ("Tank2.level", "Tank2", "model"),
        ("pidtank.x", "pidtank", "algorithm"),
        ("a.b.c", "a", "variable"),
        ("bare", "unknown", "variable"),
        ("mycontroller.y", "mycontroller", "algorithm"),
        ("model_9.z", "model_9", "model"),
    ],
)
def test_tag_split_and_type(spark, tag, inst, kind):
    r = spark.createDataFrame([(tag,)], "t string").select(
        I.instance_of("t").alias("i"), I.classify_instance(I.instance_of("t")).alias("k"), I.attribute_of("t").alias("a")
    ).first()
    assert (r.i, r.k) == (inst, kind)
    assert (I.tag_instance(tag), I.tag_type(I.tag_instance(tag))) == (inst, kind)
    assert r.a == (tag.split(".", 1)[1] if "." in tag else tag)


def test_map_ingest_try_cast(spark):
    df = spark.createDataFrame([(1, 0.5, {"a.x": "1.5", "b": "oops", "cycle_count": "3"})], "cycle_count int, sim_time double, params map<string,string>")
    rows = I.map_snapshots_to_history(df.withColumn("timestamp", F.lit(None).cast("timestamp_ntz"))).collect()
    assert [(r.param_name, r.param_value, r.instance_name) for r in rows] == [("a.x", 1.5, "a")]


def test_assign_ids_dense_ordered(spark):
    rows = [(i % 97, f"t{i % 5}") for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, t string").dropDuplicates()
    out = I.assign_ids(df, ["k", "t"], start=11, num_partitions=7).collect()
    got = sorted(out, key=lambda r: r.id)
    assert [r.id for r in got] == list(range(11, 11 + len(got)))
    assert [(r.k, r.t) for r in got] == sorted((r.k, r.t) for r in got)


def test_max_id_default(spark):
    assert I.max_id(None) == 0
    empty = spark.createDataFrame([], "id long")
    assert I.max_id(empty) == 0


def _hist(spark):
    return events_history(spark, "/root/testdata/sf0.001")


def test_history_query_filters(spark):
    h = _hist(spark)
    rows = h.collect()
    start, end = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 9)
    exp = sorted([r for r in rows if start <= r.timestamp <= end and r.instance_name == "tank1"], key=lambda r: (r.timestamp, r.id), reverse=True)[:7]
    got = Q.query_history(h, instance_name="tank1", start_time=start, end_time=end, limit=7).collect()
    assert [r.id for r in got] == [r.id for r in exp]
    # falsy arguments add no predicate
    assert Q.query_history(h, param_name="", instance_name=None, limit=5000).count() == len(rows)


def test_inclusive_bounds(spark):
    h = _hist(spark)
    t = h.orderBy("timestamp").first().timestamp
    assert Q.query_history(h, start_time=t, end_time=t).count() == 1


def test_statistics_empty_and_values(spark):
    h = _hist(spark)
    e = Q.statistics(h, "nope").first()
    assert (e["count"], e["min"], e["max"], e["avg"], e["sum"]) == (0, None, None, None, None)
    vals = [r.param_value for r in h.collect() if r.param_name == "pid0.click"]
    s = Q.statistics(h, "pid0.click").first()
    assert s["count"] == len(vals) and s["min"] == min(vals) and s["max"] == max(vals)
    assert s["sum"] == pytest.approx(sum(vals)) and s["avg"] == pytest.approx(sum(vals) / len(vals))


def test_latest_ties_highest_id(spark):
    df = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1), "a.x", 1.0), (2, dt.datetime(2024, 1, 1), "a.x", 2.0), (3, dt.datetime(2023, 1, 1), "a.x", 9.0)],
        "id long, timestamp timestamp_ntz, param_name string, param_value double",
    ).withColumn("instance_name", F.lit("a"))
    assert Q.latest_values(df).first().param_value == 2.0


def test_page_slice_clamp(spark):
    h = _hist(spark)
    expect = [r.id for r in h.orderBy("timestamp", "id").collect()[300:310]]
    assert [r.id for r in Q.page_slice(h, 300, n=10).collect()] == expect
    assert [r.id for r in Q.page_slice(h, 10**9, n=10).collect()] == [r.id for r in h.orderBy("timestamp", "id").collect()[-10:]]
    assert Q.page_slice(h, 0, n=5000).count() == h.count()


def test_iso_timestamp(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 1, 2, 3),), (dt.datetime(2024, 1, 1, 1, 2, 3, 500),)], "t timestamp_ntz")
    assert [r[0] for r in df.select(Q.iso_timestamp("t")).collect()] == ["2024-01-01T01:02:03", "2024-01-01T01:02:03.000500"]


def test_write_read_history_partitioned(spark, tmp_path):
    h = _hist(spark)
    write_history(h, str(tmp_path / "hist"), mode="overwrite")
    back = read_history(spark, str(tmp_path / "hist"))
    assert back.count() == h.count()
    q = Q.query_history(back, start_time="2024-01-05 00:00:00", end_time="2024-01-06 00:00:00")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def _page_plan_limit(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return int(re.search(r"TakeOrderedAndProject\(limit=(\d+)", plan)[1])


def test_page_of_a_dense_day_and_a_dense_instant(spark):
    """The top-k holds at most the page and the slack, wherever the rows lie."""
    t0 = dt.datetime(2024, 3, 1)
    rows = [(i, t0 + dt.timedelta(days=i % 5)) for i in range(200)]
    rows += [(1000 + i, t0 + dt.timedelta(days=2, seconds=i * 7, microseconds=i)) for i in range(3000)]  # one dense day
    rows += [(10_000 + i, t0 + dt.timedelta(days=3, hours=5)) for i in range(3000)]  # one dense instant
    rows += [(50_000 + i, None) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, timestamp timestamp_ntz")
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or t0, r[0]))]
    for start in (0, 3, 420, 490, 640, 1500, 3100, 3700, 3771, 5000, 6650, 10**9):
        page = Q.page_slice(df, start, n=40, slack=50)
        assert [r.id for r in page.collect()] == want[max(0, min(start, len(want) - 40)) :][:40], start
        assert _page_plan_limit(page) <= 90
    assert Q.page_slice(df.limit(0), 5, n=4).collect() == []


def test_newest_rows_read_the_newest_dates_only(spark, tmp_path):
    """Thirty days on disk: the plan of the last rows reads the dates that hold them."""
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(hours=i), f"pid{i % 3}.mv", float(i), f"pid{i % 3}", "algorithm", i, i * 0.5) for i in range(30 * 24)]
    path = str(tmp_path / "history")
    write_history(spark.createDataFrame(rows, HISTORY_SCHEMA), path)
    h = read_history(spark, path)

    def files_read(df):
        df.collect()
        found = df._jdf.queryExecution().executedPlan().collectLeaves()
        return found.head().metrics().apply("numFiles").value()

    assert len(Q.partition_dates(h)) == 30 and Q.partition_dates(h)[0] == dt.date(2024, 1, 30)
    last = Q.query_history(h, limit=20)
    assert [r.id for r in last.collect()] == list(range(719, 699, -1)) and files_read(last) <= 2
    tag = Q.query_history(h, param_name="pid1.mv", limit=20)
    assert [r.id for r in tag.collect()] == [i for i in range(719, -1, -1) if i % 3 == 1][:20] and files_read(tag) <= 6
    bounded = Q.query_history(h, end_time="2024-01-10T12:00:00", limit=5)
    assert [r.id for r in bounded.collect()] == list(range(228, 223, -1)) and files_read(bounded) <= 2
    assert Q.query_history(h, param_name="none", limit=5).collect() == []
    assert len(Q.query_history(h, limit=10**6).collect()) == 720
