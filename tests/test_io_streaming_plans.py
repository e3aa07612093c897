"""S11-S17 CSV / JSON, T1-T5 streaming (= batch), and plan-shape assertions."""

import datetime as dt
import glob
import os
import uuid

import pytest
from pyspark.sql import functions as F

from tagloom.operators import query as Q
from tagloom.operators import sampling as P
from tagloom.operators import series as S
from tagloom.plans import catalog
from tagloom.sources import csv_template as CSV
from tagloom.sources import envelope as J
from tagloom.sources import timeparse as TP
from tagloom.sources.history import events_history
from tagloom.streaming import ingest as ST

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "v", [0.0, -0.0, 1.0, 50.5, 0.1, 1e-4, 1.5e-4, 1e-5, 123456789.0, 12345678.9, 1e16, 1.2345e20, -3.25e-7, 1e7, 9999999.0, 2.5e15]
)
def test_python_double_text(spark, v):
    got = spark.createDataFrame([(v,)], "x double").select(CSV.py_double_text(F.col("x")).alias("t")).first().t
    assert got == str(v)


def _wide(spark):
    return spark.createDataFrame(
        [(1, True, 0.5, 50.5, None, "a,b"), (2, False, 1.0, 1.0, 2.0, "x"), (3, True, 1.5, 30.0, 1e20, "y")],
        "cycle_count int, need_sample boolean, sim_time double, `tank1.level` double, `pid1.mv` double, `s.txt` string",
    )


def _read_all(path):
    parts = sorted(glob.glob(os.path.join(path, "part-*")))
    return b"".join(open(p, "rb").read() for p in parts).decode("utf-8")


@pytest.mark.parametrize("single", [True, False])
def test_export_two_header_rows(spark, tmp_path, single):
    out = str(tmp_path / "e")
    assert CSV.export_csv(_wide(spark), out, "prediction", single_file=single) == 1
    text = _read_all(out)
    lines = text.split("\r\n")
    assert lines[0] == "timeStamp,TANK1.LEVEL,PID1.MV,S.TXT"
    assert lines[1] == "时间戳,某工业数据,某工业数据,某工业数据"
    assert lines[2] == '1970-01-01 00:00:00,50.5,,"a,b"'
    assert lines[3] == "1970-01-01 00:00:01,30.0,1e+20,y"
    back = CSV.read_template_csv(spark, out, "prediction").orderBy("time").collect()
    assert [(r["TANK1.LEVEL"], r["PID1.MV"]) for r in back] == [(50.5, None), (30.0, 1e20)]
    assert back[1].time == dt.datetime(1970, 1, 1, 0, 0, 1)


def test_export_nothing_sampled(spark, tmp_path):
    out = str(tmp_path / "none")
    assert CSV.export_csv(_wide(spark).drop("need_sample"), out, "ai_loop_tuning") == 0
    assert not os.path.exists(out)


def test_template_rules():
    assert CSV.load_template("pid_loop_tuning").time_column_name == "时间"
    assert CSV.list_templates() == ["ai_loop_tuning", "pid_loop_tuning", "prediction"]
    with pytest.raises(ValueError):
        CSV.ExportTemplate("x", header_rows=3)
    t = CSV.template_from_mapping("m", {"header_rows": 2, "columns": ["ignored"]})
    assert t.header_rows == 2 and t.time_format == "%Y/%m/%d %H:%M:%S"


def test_template_from_a_file(tmp_path):
    path = tmp_path / "plant.yaml"
    path.write_text('# two header rows\ntime_column_name: "时间"\ntime_format: "%Y-%m-%d %H:%M:%S"  \nheader_rows: 2 # fixed\nuppercase_column_names: false\ncolumns:\n  - ignored\n', encoding="utf-8")
    t = CSV.template_from_file(str(path))
    assert t == CSV.ExportTemplate("plant", "时间", "%Y-%m-%d %H:%M:%S", 2, False)
    path.write_text("name: other\nheader_rows: 3\n")
    with pytest.raises(ValueError):
        CSV.template_from_file(str(path))
    try:
        assert CSV.load_template(CSV.register_template(t).name) == t
    finally:
        CSV.TEMPLATES.pop("plant")


def test_time_parse_fallback(spark):
    df = spark.createDataFrame([("2024-05-24 10:00:00",), ("2024/05/24 10:00:01",), ("garbage",)], "t string")
    got = [r.p for r in df.select(CSV.parse_time(F.col("t")).alias("p")).collect()]
    assert got == [dt.datetime(2024, 5, 24, 10), dt.datetime(2024, 5, 24, 10, 0, 1), None]


T = dt.datetime


@pytest.mark.parametrize(
    "texts, want",
    [
        (["May 24 2024 10:00", "Sep 3 2024 7:05"], [T(2024, 5, 24, 10), T(2024, 9, 3, 7, 5)]),
        (["20240524 100000", "20240524 101530"], [T(2024, 5, 24, 10), T(2024, 5, 24, 10, 15, 30)]),
        (["05/24/2024 1:02 PM", "05/03/2024 12:30 am"], [T(2024, 5, 24, 13, 2), T(2024, 5, 3, 0, 30)]),
        (["24/05/2024 10:00:00", "03/05/2024 11:00:00"], [T(2024, 5, 24, 10), T(2024, 5, 3, 11)]),  # a day above 12 settles it
        (["03/05/2024 10:00:00", "04/05/2024 10:00:00"], [T(2024, 3, 5, 10), T(2024, 4, 5, 10)]),  # nothing does: month first
        (["24/05/2024", "05/25/2024", "04/05/2024"], [T(2024, 5, 24), T(2024, 5, 25), T(2024, 4, 5)]),  # both: by the row
        (["2024-05-24T10:00:00.123", "2024-05-24T10:00:00.123456", "2024-05-24T10:00:00Z", "2024-05-24T10:00:00+08:00", "2024-05-24 10:00:00 UTC"], [T(2024, 5, 24, 10, 0, 0, 123000), T(2024, 5, 24, 10, 0, 0, 123456), T(2024, 5, 24, 10), T(2024, 5, 24, 2), T(2024, 5, 24, 10)]),
        (["24 December 2024", "December 24, 2024 10:00", "24-Dec-2024 08:01:02", "Tuesday, December 24, 2024"], [T(2024, 12, 24), T(2024, 12, 24, 10), T(2024, 12, 24, 8, 1, 2), T(2024, 12, 24)]),
        (["2024.05.24  10:00:00", "2024/5/4 9:08", "20240524101112", "2024-05-24"], [T(2024, 5, 24, 10), T(2024, 5, 4, 9, 8), T(2024, 5, 24, 10, 11, 12), T(2024, 5, 24)]),
        (["2024-03-10 02:30:00", "2024-11-03 01:30:00"], [T(2024, 3, 10, 2, 30), T(2024, 11, 3, 1, 30)]),  # skipped and repeated hours of a zone
        ([None, "", "garbage", "2024-13-40 10:00:00", "12", "a 2024-05-24", "99:99"], [None] * 7),
    ],
)
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_time_formats_are_induced_from_the_column(spark, texts, want, zone):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = [r.at for r in TP.parse_times(df, "t", "at").orderBy("i").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == want


def test_data_rows_that_repeat_the_header(spark, tmp_path):
    for name, template, lines, values in [
        ("one", None, ["t,X", "2024-05-24 10:00:00,1", "t,X", "2024-05-24 10:00:01,2"], [1.0, 2.0, None]),
        ("two", "prediction", ["timeStamp,X", "d,e", "d,e", "2024-05-24 10:00:00,1", "timeStamp,X", "d,e"], [1.0, None, None, None]),
        ("same", "prediction", ["timeStamp,X", "timeStamp,X", "2024-05-24 10:00:00,1", "timeStamp,X"], [1.0, None]),
        ("rows", "prediction", ["timeStamp,X", "2024-05-24 10:00:00,1", "2024-05-24 10:00:01,2", "2024-05-24 10:00:00,1"], [1.0, 2.0]),  # the second row goes by its place
    ]:
        path = tmp_path / f"{name}.csv"
        path.write_text("\n".join(lines) + "\n")
        got = [r.X for r in CSV.read_template_csv(spark, str(path), template).collect()]
        assert sorted(got, key=lambda v: (v is None, v)) == values, name


def test_envelope_roundtrip_and_rejects(spark):
    wide = spark.createDataFrame([(1, 0.5, "t0", 50.5, 30.0)], "cycle_count int, sim_time double, time_str string, `tank1.level` double, `pid1.mv` double")
    texts = J.encode_envelope(wide)
    bad = spark.createDataFrame([("{",), (None,), ('{"params":{}}',), ('{"timestamp": 1}',), ("[1,2]",), ('{"params":{"v1.x":"abc","v2.y":7}}',)], "value string")
    good, rejected = J.decode_envelope(texts.unionByName(bad))
    assert sorted((r.param_name, r.param_value, r.param_type) for r in good.collect()) == [
        ("pid1.mv", 30.0, "algorithm"),
        ("tank1.level", 50.5, "model"),
        ("v2.y", 7.0, "variable"),
    ]
    assert sorted(r.reason for r in rejected.collect()) == ["malformed", "malformed", "malformed", "no_params", "no_params"]
    note = J.notification(wide).first().value
    assert note == '{"timestamp":0.5,"cycle_count":1}'


def test_envelope_keeps_every_type(spark):
    schema = "cycle_count int, sim_time double, `a.x` double, `a.text` string, `a.digits` string, `a.flag` boolean, `a.gone` double, `a.list` array<int>"
    wide = spark.createDataFrame([(2, 1.0, float("nan"), "on", "12", True, None, [1]), (1, 0.5, 7.25, "off", "13", False, 3.0, [2])], schema)
    texts = J.encode_envelope(wide)
    assert '"a.text":"on","a.digits":"12","a.flag":true,"a.gone":null,"a.list":[1]' in texts.first().value
    good, rejected = J.decode_envelope(texts)
    assert rejected.count() == 0
    assert sorted((r.param_name, str(r.param_value)) for r in good.collect()) == [("a.flag", "0.0"), ("a.flag", "1.0"), ("a.gone", "3.0"), ("a.x", "7.25"), ("a.x", "nan")]
    found = J.discovered_tags(J.decode_envelope(texts, numeric_only=False)[0]).collect()
    assert {r.param_name: (r.first_seen, r.initial_value) for r in found} == {
        "a.x": (0.5, 7.25), "a.text": (0.5, 0.0), "a.digits": (0.5, 0.0), "a.flag": (0.5, 0.0), "a.gone": (0.5, 3.0), "a.list": (0.5, 0.0)
    }


def _paths(spark, tag):
    base = f"{spark.sparkContext.getCheckpointDir()}/test-{tag}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/ckpt"


def test_stream_slew_equals_batch(spark):
    a = {(r.event_id, r.opening) for r in catalog.stream_slew(spark, SF).collect()}
    b = {(r.event_id, r.opening) for r in catalog.slew_limit(spark, SF).collect()}
    assert a == b and len(a) == 1000


def test_stream_lag_equals_batch(spark):
    a = {(r.event_id, r.lag3) for r in catalog.stream_lag(spark, SF).collect()}
    b = {(r.event_id, r.lag3) for r in catalog.lag_default(spark, SF).collect()}
    assert a == b


def test_stream_sampler_matches_sequential(spark):
    kept = {r.event_id for r in catalog.stream_sampler(spark, SF).collect()}
    ev = spark.read.parquet(f"{SF}/events.parquet").collect()
    exp = set()
    for et in {r.event_type for r in ev}:
        last = None
        for r in sorted((r for r in ev if r.event_type == et), key=lambda r: r.ts):
            if last is None or (r.ts - last).total_seconds() >= 3600:
                exp.add(r.event_id)
                last = r.ts
    assert kept == exp


def _keyed(spark, batches, prog, inputs, params, **kw):
    """Rows (k, us, value, rid) in one micro-batch a list, through a program, closed at the end."""
    schema = "k string, us long, value double, rid int"
    src, _ = _paths(spark, "keyed-src")
    out, ckpt = _paths(spark, "keyed")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = ST.with_closing(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), "us", f"{out}-end")
    res = ST.keyed_state(stream, prog, ["k"], "us", inputs, params, passthrough=["rid"], tie_break=["rid"], **kw)
    return ST.run_available(res, out, ckpt, closing=("us", f"{out}-end")).collect()


def test_keyed_state_orders_rows_and_flags_late_ones(spark):
    s = 1_000_000
    batches = [[("a", 5 * s, 1.0, 1), ("a", 3 * s, 2.0, 2)], [("a", 20 * s, 4.0, 3)], [("a", 1 * s, 9.0, 4), ("a", 19 * s, 5.0, 5), ("a", 30 * s, 6.0, 6), ("a", None, 7.0, 7)]]
    got = sorted((r.rid, r.lagged, r.late) for r in _keyed(spark, batches, "LAG", {"value": "value"}, {"n": 1}))
    # rid 2 (3 s) goes before rid 1; rid 4 comes after rid 1 was applied; rid 5 still goes before rid 3, which waits for its slot
    assert got == [(1, 2.0, False), (2, 0.0, False), (3, 5.0, False), (4, None, True), (5, 1.0, False), (6, 4.0, False), (7, None, True)]


def test_keyed_state_keeps_nan_apart_from_null_and_sorts_ties(spark):
    rows = [("a", 1, 1.0, 1), ("a", 2, float("nan"), 2), ("a", 3, None, 3)]
    got = sorted((r.rid, r.current_opening) for r in _keyed(spark, [rows], "VALVE", {"target": "value"}, {}))
    assert [x for _, x in got] == [1.0, 6.0, 11.0]
    ties = [("a", 7, float(i), i) for i in (3, 1, 2)]
    assert sorted((r.rid, r.lagged) for r in _keyed(spark, [ties], "LAG", {"value": "value"}, {"n": 1})) == [(1, 0.0), (2, 1.0), (3, 2.0)]


def test_keyed_state_holds_a_slot_not_a_key(spark):
    """90 % of the rows on one key: what is unpickled at a time stays the rows of a slot (asserted in the step)."""
    from tagloom.functions.registry import Program, register_algorithm

    def step(state, row, params):
        import gc

        waiting = max((len(o) for o in gc.get_objects() if type(o) is list and o and type(o[0]) is tuple and len(o[0]) == 4 and isinstance(o[0][0], int) and isinstance(o[0][1], tuple)), default=0) if state % 50 == 0 else 0
        return state + 1, {"n": state, "held": waiting}

    register_algorithm(Program("HELD", "algorithm", step, lambda p: 0, ("n", "held")))
    rows = [("hot" if i % 10 else f"k{i % 30}", (i * 7919 % 2000) * 500_000, 0.0, i) for i in range(2000)]
    got = _keyed(spark, [rows[:1000], rows[1000:]], "HELD", {}, {}, output_types={"n": "long", "held": "long"})
    assert len(got) == 2000 and max(r.held for r in got) <= 2
    hot = [r for r in got if r.k == "hot" and not r.late]
    assert sorted(r.n for r in hot) == list(range(len(hot)))


def test_streams_read_folders_of_part_files(spark):
    src, _ = _paths(spark, "parts")
    spark.read.parquet(f"{SF}/events.parquet").repartition(4).write.parquet(f"{src}/events.parquet")
    want = {tuple(r) for r in catalog.stream_new_tags(spark, SF).collect()}
    assert {tuple(r) for r in catalog.stream_new_tags(spark, src).collect()} == want
    assert {tuple(r) for r in catalog.stream_ingest(spark, src).collect()} == {tuple(r) for r in catalog.stream_ingest(spark, SF).collect()}


def test_ingest_epoch_replay_is_idempotent(spark):
    out, _ = _paths(spark, "replay")
    ev = spark.read.parquet(f"{SF}/events.parquet").limit(50)
    wide = catalog._stream_wide(ev)
    writer = ST.history_batch_writer(out)
    writer(wide, 0)
    writer(wide, 1)
    writer(wide, 1)  # replay of epoch 1
    hist = spark.read.parquet(out)
    ids = sorted(r.id for r in hist.collect())
    assert ids == list(range(1, len(ids) + 1)) and len(ids) == 2 * 2 * 25


def test_replay_without_a_time_column_keeps_the_first_time(spark, monkeypatch):
    """The epoch is written again two days later and in other zones: the same rows, under the same date."""
    out, _ = _paths(spark, "stamp")
    wide = catalog._stream_wide(spark.read.parquet(f"{SF}/events.parquet").limit(20)).drop("timestamp")
    writer = ST.history_batch_writer(out)
    clock = [dt.datetime(2024, 5, 1, 23, 59, 59, 5), dt.datetime(2024, 5, 3, 0, 0, 1)]

    class Clock(dt.datetime):
        @classmethod
        def now(cls, tz=None):
            return clock[0].replace(tzinfo=tz)

    monkeypatch.setattr(ST._dt, "datetime", Clock)
    writer(wide, 0)
    first = sorted(map(tuple, spark.read.parquet(out).collect()))
    clock.pop(0)
    for zone in ("Asia/Kolkata", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            writer(wide, 0)
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    again = spark.read.parquet(out)
    assert sorted(map(tuple, again.collect())) == first and len(first) == 20
    assert [r[0] for r in again.select("timestamp").distinct().collect()] == [dt.datetime(2024, 5, 1, 23, 59, 59, 5)]
    writer(wide, 1)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(1, 41))
    assert {r[0] for r in spark.read.parquet(out).where("epoch = 1").select("timestamp").distinct().collect()} == {dt.datetime(2024, 5, 3, 0, 0, 1)}


def test_plans_stay_jvm_and_push_filters(spark):
    h = events_history(spark, SF)
    plan = Q.query_history(h, param_name="pid0.click", limit=5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan
    stats = Q.statistics_by_tag(h)._jdf.queryExecution().executedPlan().toString()
    assert "partial_" in stats  # map-side partial aggregation before the shuffle
    for q in (Q.latest_values(h), Q.tag_catalog(h)):
        p = q._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in p and "partial_" in p  # hash aggregate, no per-task sort
    read = spark.read.parquet(f"{SF}/events.parquet").filter("value > 3").select("event_id")
    rp = read._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,3.0)]" in rp and "ReadSchema: struct<event_id:bigint,value:double>" in rp


def test_series_windows_never_single_partition(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    spec = S.series_spec(ev, ["event_type"], ["ts", "event_id"], chunk_size=86400)
    for df in (S.lag(ev, spec, "value", 3), S.hold_last(ev, spec, "value"), S.running_sum(ev, spec, F.col("value"), "acc")):
        p = df._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in p


def test_sampling_plan_has_no_single_partition(spark):
    h = events_history(spark, SF)
    q = P.query_sampled(h, sample_interval=600.0, limit=None)
    assert "SinglePartition" not in q._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("zone", ["Asia/Kolkata", "America/New_York"])
@pytest.mark.parametrize("name", ["history_query", "distinct_times", "cycle_sample", "sampled_query", "latest_ties"])
def test_results_do_not_depend_on_session_zone(spark, name, zone):
    fn = catalog.QUERIES[name]
    base = sorted(tuple(r) for r in fn(spark, SF).collect())
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        other = sorted(tuple(r) for r in fn(spark, SF).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert base == other


# Python runs only in P1 (numpy passes), R1/R2 chunk folds, step programs and the final rounding of exact sums.
_PYTHON_KEYS = {"sampled_query", "sampled_instance", "sampled_global", "slew_limit", "slew_limit_slow", "program_total", "statistics_exact", "integral_exact", "user_function"}
_SIDE_EFFECT_KEYS = {"csv_roundtrip", "history_table_query"}


def test_builtin_operators_have_no_python_in_plan(spark):
    py_nodes = ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonMapInArrow")
    for name, fn in catalog.QUERIES.items():
        if name in _PYTHON_KEYS or name in _SIDE_EFFECT_KEYS or name.startswith("stream_"):
            continue
        plan = fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(n in plan for n in py_nodes), name


def test_series_summaries_hash_aggregate(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    spec = S.series_spec(ev, ["event_type"], ["ts", "event_id"], chunk_size=86400)
    for df in (S.hold_last(ev, spec, "value"), S.lag(ev, spec, "value", 1), S.pid_response(ev, spec, "value", 50.0)):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_strftime_translation_quotes_literals():
    from tagloom.operators.clock import strftime_to_java

    assert strftime_to_java("%Y-%m-%d %H:%M:%S") == "yyyy-MM-dd HH:mm:ss"
    assert strftime_to_java("%Y/%m/%d") == "yyyy/MM/dd"
    assert strftime_to_java("day %d at %H") == "'day 'dd' at 'HH"
    assert strftime_to_java("%y%m") == "yyMM"
    with pytest.raises(ValueError):
        strftime_to_java("%j")


def test_export_keeps_case_and_scan_falls_back_to_first_column(spark, tmp_path):
    tpl = CSV.ExportTemplate("lower", time_column_name="t", time_format="%H:%M:%S", header_rows=1, uppercase_column_names=False)
    out = str(tmp_path / "lower")
    CSV.export_csv(_wide(spark), out, tpl, single_file=True)
    lines = _read_all(out).split("\r\n")
    assert lines[0] == "t,tank1.level,pid1.mv,s.txt" and lines[1].startswith("00:00:00,")
    # a template whose time column is absent: the first column is the time column
    other = CSV.ExportTemplate("other", time_column_name="absent")
    back = CSV.read_template_csv(spark, out, other)
    assert back.columns == ["time", "time_text", "tank1.level", "pid1.mv", "s.txt"]
    assert back.count() == 2 and back.filter("time IS NULL").count() == 2  # HH:mm:ss alone is not a full timestamp


def test_keyed_state_merges_sorted_runs_by_blocks():
    """Rows in any order come out in order, whole or up to a time, by few calls to the store and in small tables."""
    import random

    import pyarrow as pa

    from tagloom.streaming import keyed as K

    class Store(dict):
        calls = 0

        def updateValue(self, key, value):
            self.calls += 1
            self[key] = value

        def getValue(self, key):
            self.calls += 1
            return self[key]

        def removeKey(self, key):
            self.calls += 1
            del self[key]

    rows = [(at // 3 * 7, i) for i, at in enumerate(random.Random(5).sample(range(60_000), 60_000))]
    store, largest = Store(), 0
    runs = K.Runs(store, [], 1)
    for n in range(0, len(rows), 300):  # 200 runs: more than are merged at once
        part = rows[n : n + 300]
        runs.add(K._sorted(pa.table({"at": [r[0] for r in part], "t0": [r[1] for r in part]}), 1))
    got = []
    for until in (1, 50_000, 50_001, None):
        for table in runs.take(until):
            largest = max(largest, table.num_rows)
            got += zip(table.column("at").to_pylist(), table.column("t0").to_pylist())
        assert got == [r for r in sorted(rows) if until is None or r[0] < until]
        assert runs.first() == min((at for at, _ in rows if until is not None and at >= until), default=None)
    assert not store and not runs.open
    assert store.calls < len(rows) / 20 and largest < len(rows) / 4


def test_times_of_usual_masks_are_read_without_a_look_at_their_shape(spark):
    """Texts go by their mask (digits as 0) where it is plain; others, such as those with a zone, still go by their shape."""
    from tagloom.sources import timeparse

    texts = ["May 4 2024 10:00", "Jun 14 2024 09:30", "2024-05-04 10:00:00", "2024-05-04T10:00:00+02:00", " 2024-05-04  11:00:00 ", "Sat, 2024-05-04 12:00:00", "13/05/2024 01:02:03", "2024-02-30 00:00:00", "no time", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = timeparse.induce(df, "t")
    assert set(found.usual) == {"May 0 0000 00:00", "Jun 00 0000 00:00", "0000-00-00 00:00:00", "00/00/0000 00:00:00"}
    plain = timeparse.Formats(found)  # nothing is usual: all go by their shape
    got = df.select(timeparse.parse(F.col("t"), found).cast("string").alias("a"), timeparse.parse(F.col("t"), plain).cast("string").alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]
    assert [r.a for r in got] == ["2024-05-04 10:00:00", "2024-06-14 09:30:00", "2024-05-04 10:00:00", "2024-05-04 08:00:00", "2024-05-04 11:00:00", "2024-05-04 12:00:00", "2024-05-13 01:02:03", None, None, None]
