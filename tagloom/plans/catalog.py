"""Registered queries: each key has a Spark plan builder and, where SQL can say
the same thing, an equivalent DuckDB query over the raw driver tables.

Every query reads the driver tables (``events``, ``lineitem``) whole, or data
Spark derives from them, so its work grows with the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators import ingest as I
from tagloom.operators import query as Q
from tagloom.operators import clock as C
from tagloom.operators import fold as R
from tagloom.operators import sampling as P
from tagloom.operators import series as S
from tagloom.operators.program import run_program
from tagloom.functions import math as M
from tagloom.functions.formula import formula_columns as _formulas
from tagloom.session import scratch_path
from tagloom.sources import csv_template as CSV
from tagloom.sources import envelope as J
from tagloom.sources import generate as G
from tagloom.sources import rollup
from tagloom.sources.history import LINEITEM_TAGS, events_history, history_from_events, append_history, read_history, table, wide_from_lineitem, write_history

QueryFn = Callable[[SparkSession, str], DataFrame]

# Fixed query parameters used by the registered keys.
RANGE_START = "2024-01-03 00:00:00"
RANGE_END = "2024-01-25 12:00:00"
ONE_TAG = "pid0.click"
ONE_INSTANCE = "tank1"

# --- DuckDB side: the history view over events, spelled in SQL --------------
HISTORY_SQL = """
history AS (
  SELECT id, timestamp, param_name, param_value, instance_name,
         CASE WHEN regexp_matches(lower(instance_name), 'pid|controller|algorithm') THEN 'algorithm'
              WHEN regexp_matches(lower(instance_name), 'tank|valve|model') THEN 'model'
              ELSE 'variable' END AS param_type,
         cycle_count, sim_time
  FROM (
    SELECT id, timestamp, param_name, param_value,
           CASE WHEN strpos(param_name, '.') > 0 THEN split_part(param_name, '.', 1) ELSE 'unknown' END AS instance_name,
           cycle_count, sim_time
    FROM (
      SELECT CAST(event_id + 1 AS BIGINT) AS id,
             ts AS timestamp,
             CASE WHEN event_type = 'error' THEN 'error'
                  ELSE (CASE user_id % 4 WHEN 0 THEN 'pid' WHEN 1 THEN 'tank' WHEN 2 THEN 'valve' ELSE 'sensor' END)
                       || CAST(user_id % 16 AS VARCHAR) || '.' || event_type END AS param_name,
             CAST(value AS DOUBLE) AS param_value,
             CAST(event_id + 1 AS INTEGER) AS cycle_count,
             CAST((event_id + 1) * 0.5 AS DOUBLE) AS sim_time
      FROM events
    )
  )
)"""

HISTORY_COLS_SQL = "id, timestamp, param_name, param_value, instance_name, param_type, cycle_count, sim_time"


def _with(sql: str, *ctes: str) -> str:
    return "WITH " + ",\n".join((HISTORY_SQL,) + ctes) + "\n" + sql


# --- Spark side ---------------------------------------------------------------

def history_query(spark: SparkSession, sf: str) -> DataFrame:
    h = events_history(spark, sf)
    return Q.query_history(h, start_time=RANGE_START, end_time=RANGE_END, limit=1000)


def history_tag_query(spark: SparkSession, sf: str) -> DataFrame:
    h = events_history(spark, sf)
    return Q.query_history(h, param_name=ONE_TAG, limit=1000)


def history_instance_query(spark: SparkSession, sf: str) -> DataFrame:
    h = events_history(spark, sf)
    return Q.query_history(h, instance_name=ONE_INSTANCE, start_time=RANGE_START, limit=100)


def _round_stats(df: DataFrame) -> DataFrame:
    return df.select(
        "param_name",
        "count",
        F.round("min", 4).alias("min"),
        F.round("max", 4).alias("max"),
        F.round("avg", 4).alias("avg"),
        F.round("sum", 4).alias("sum"),
    )


def statistics_one(spark: SparkSession, sf: str) -> DataFrame:
    h = events_history(spark, sf)
    return _round_stats(Q.statistics(h, ONE_TAG, start_time=RANGE_START, end_time=RANGE_END))


def statistics_empty(spark: SparkSession, sf: str) -> DataFrame:
    h = events_history(spark, sf)
    return _round_stats(Q.statistics(h, "no.such_tag"))


def statistics_all(spark: SparkSession, sf: str) -> DataFrame:
    h = events_history(spark, sf)
    return _round_stats(Q.statistics_by_tag(h))


def statistics_exact(spark: SparkSession, sf: str) -> DataFrame:
    return _round_stats(Q.statistics_exact(events_history(spark, sf)))


def records_per_tag(spark: SparkSession, sf: str) -> DataFrame:
    return Q.records_per_tag(events_history(spark, sf))


def latest_values(spark: SparkSession, sf: str) -> DataFrame:
    return Q.latest_values(events_history(spark, sf)).select("param_name", "param_value")


def latest_by_instance(spark: SparkSession, sf: str) -> DataFrame:
    return Q.latest_values(events_history(spark, sf), instance_name=ONE_INSTANCE).select("param_name", "param_value")


def latest_ties(spark: SparkSession, sf: str) -> DataFrame:
    h = events_history(spark, sf, hour_ties=True)
    return Q.latest_values(h).select("param_name", "param_value", "timestamp")


def tag_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return Q.tag_catalog(events_history(spark, sf))


def distinct_times(spark: SparkSession, sf: str) -> DataFrame:
    return Q.distinct_timestamps(events_history(spark, sf, hour_ties=True))


def iso_history(spark: SparkSession, sf: str) -> DataFrame:
    h = events_history(spark, sf, hour_ties=False)
    q = Q.query_history(h, param_name=ONE_TAG, limit=50)
    return q.select("id", Q.iso_timestamp("timestamp").alias("timestamp_iso"))


def page_slice(spark: SparkSession, sf: str) -> DataFrame:
    h = events_history(spark, sf)
    return Q.page_slice(h, start=5000, n=1000).select("id", "timestamp", "param_name", "param_value")


def page_slice_clamped(spark: SparkSession, sf: str) -> DataFrame:
    h = events_history(spark, sf)
    return Q.page_slice(h, start=10**12, n=1000).select("id", "timestamp", "param_name", "param_value")


# --- oracle SQL ------------------------------------------------------------------

STAT_COLS_SQL = "count(*) AS count, round(min(param_value), 4) AS min, round(max(param_value), 4) AS max, round(avg(param_value), 4) AS avg, round(sum(param_value), 4) AS sum"

ORACLE: dict[str, str] = {
    "history_query": _with(
        f"SELECT {HISTORY_COLS_SQL} FROM history WHERE timestamp >= TIMESTAMP '{RANGE_START}' AND timestamp <= TIMESTAMP '{RANGE_END}' "
        "ORDER BY timestamp DESC, id DESC LIMIT 1000"
    ),
    "history_tag_query": _with(
        f"SELECT {HISTORY_COLS_SQL} FROM history WHERE param_name = '{ONE_TAG}' ORDER BY timestamp DESC, id DESC LIMIT 1000"
    ),
    "history_instance_query": _with(
        f"SELECT {HISTORY_COLS_SQL} FROM history WHERE instance_name = '{ONE_INSTANCE}' AND timestamp >= TIMESTAMP '{RANGE_START}' "
        "ORDER BY timestamp DESC, id DESC LIMIT 100"
    ),
    "statistics_one": _with(
        f"SELECT '{ONE_TAG}' AS param_name, {STAT_COLS_SQL} FROM history WHERE param_name = '{ONE_TAG}' "
        f"AND timestamp >= TIMESTAMP '{RANGE_START}' AND timestamp <= TIMESTAMP '{RANGE_END}'"
    ),
    "statistics_empty": _with(f"SELECT 'no.such_tag' AS param_name, {STAT_COLS_SQL} FROM history WHERE param_name = 'no.such_tag'"),
    "statistics_exact": _with(f"SELECT param_name, {STAT_COLS_SQL} FROM history GROUP BY param_name"),
    "statistics_all": _with(f"SELECT param_name, {STAT_COLS_SQL} FROM history GROUP BY param_name"),
    "records_per_tag": _with("SELECT param_name, count(*) AS records FROM history GROUP BY param_name"),
    "latest_values": _with(
        "SELECT param_name, param_value FROM (SELECT param_name, param_value, row_number() OVER "
        "(PARTITION BY param_name ORDER BY timestamp DESC, id DESC) AS rn FROM history) WHERE rn = 1"
    ),
    "latest_by_instance": _with(
        "SELECT param_name, param_value FROM (SELECT param_name, param_value, row_number() OVER "
        f"(PARTITION BY param_name ORDER BY timestamp DESC, id DESC) AS rn FROM history WHERE instance_name = '{ONE_INSTANCE}') WHERE rn = 1"
    ),
    "latest_ties": _with(
        "SELECT param_name, param_value, timestamp FROM (SELECT param_name, param_value, timestamp, row_number() OVER "
        "(PARTITION BY param_name ORDER BY timestamp DESC, id DESC) AS rn FROM history_h) WHERE rn = 1",
        f"history_h AS (SELECT id, date_trunc('hour', timestamp) AS timestamp, param_name, param_value FROM history)",
    ),
    "tag_catalog": _with(
        "SELECT param_name, first_seen, initial_value, instance_name, param_type, records FROM ("
        "SELECT param_name, min(timestamp) OVER w AS first_seen, first_value(param_value) OVER w2 AS initial_value, "
        "instance_name, param_type, count(*) OVER w AS records, row_number() OVER w2 AS rn FROM history "
        "WINDOW w AS (PARTITION BY param_name), w2 AS (PARTITION BY param_name ORDER BY timestamp, id)) WHERE rn = 1"
    ),
    "distinct_times": _with("SELECT DISTINCT date_trunc('hour', timestamp) AS timestamp FROM history"),
    "iso_history": _with(
        "SELECT id, CASE WHEN microsecond(timestamp) % 1000000 = 0 THEN strftime(timestamp, '%Y-%m-%dT%H:%M:%S') "
        "ELSE strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') END AS timestamp_iso "
        f"FROM history WHERE param_name = '{ONE_TAG}' ORDER BY timestamp DESC, id DESC LIMIT 50"
    ),
    "page_slice": _with(
        "SELECT id, timestamp, param_name, param_value FROM history ORDER BY timestamp, id LIMIT 1000 OFFSET 5000"
    ),
    "page_slice_clamped": _with(
        "SELECT id, timestamp, param_name, param_value FROM history ORDER BY timestamp, id "
        "LIMIT 1000 OFFSET (SELECT greatest(0, count(*) - 1000) FROM history)"
    ),
}

QUERIES: dict[str, QueryFn] = {
    "history_query": history_query,
    "history_tag_query": history_tag_query,
    "history_instance_query": history_instance_query,
    "statistics_one": statistics_one,
    "statistics_empty": statistics_empty,
    "statistics_all": statistics_all,
    "statistics_exact": statistics_exact,
    "records_per_tag": records_per_tag,
    "latest_values": latest_values,
    "latest_by_instance": latest_by_instance,
    "latest_ties": latest_ties,
    "tag_catalog": tag_catalog,
    "distinct_times": distinct_times,
    "iso_history": iso_history,
    "page_slice": page_slice,
    "page_slice_clamped": page_slice_clamped,
}


# --- ingest (S2-S9) -----------------------------------------------------------

def ingest_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    wide = wide_from_lineitem(table(spark, sf, "lineitem"))
    return I.snapshots_to_history(wide, "timestamp", id_columns=["l_orderkey", "l_linenumber"])


def ingest_allow_list(spark: SparkSession, sf: str) -> DataFrame:
    wide = wide_from_lineitem(table(spark, sf, "lineitem"))
    long = I.snapshots_to_history(wide, "timestamp", stored_variables=["pump.price", "pid.tax", "pump.flag"], id_columns=["l_orderkey", "l_linenumber"])
    return long.select("l_orderkey", "l_linenumber", "param_name", "param_value", "instance_name", "param_type")


def assign_ids(spark: SparkSession, sf: str) -> DataFrame:
    wide = wide_from_lineitem(table(spark, sf, "lineitem"))
    long = I.snapshots_to_history(wide, "timestamp", id_columns=["l_orderkey", "l_linenumber"])
    start = I.max_id(events_history(spark, sf)) + 1
    ided = I.assign_ids(long, ["timestamp", "l_orderkey", "l_linenumber", "param_name"], start=start)
    return ided.select("id", "l_orderkey", "l_linenumber", "param_name")


# --- per-series windows (W1-W6) ------------------------------------------------

def _recorded(spark: SparkSession, sf: str, gaps: bool = False) -> DataFrame:
    ev = table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    if gaps:
        ev = ev.withColumn("value", F.when(F.col("value") > 50, F.lit(None).cast("double")).otherwise(F.col("value")))
    return ev


def _spec(df: DataFrame) -> S.SeriesSpec:
    return S.series_spec(df, ["event_type"], ["ts", "event_id"])


def lag_default(spark: SparkSession, sf: str) -> DataFrame:
    ev = _recorded(spark, sf)
    return S.lag(ev, _spec(ev), "value", 3, default=0.0, out="lag3").select("event_id", "event_type", "value", "lag3")


def lag_one(spark: SparkSession, sf: str) -> DataFrame:
    ev = _recorded(spark, sf)
    return S.lag(ev, _spec(ev), "value", -1, default=0.0, out="lag1").select("event_id", "event_type", "lag1")


def lag_seeded(spark: SparkSession, sf: str) -> DataFrame:
    ev = _recorded(spark, sf)
    return S.lag(ev, _spec(ev), "value", 4, default=0.0, out="lagx", inclusive=True, initial=-1.0).select("event_id", "event_type", "lagx")


def hold_last(spark: SparkSession, sf: str) -> DataFrame:
    ev = _recorded(spark, sf, gaps=True)
    return S.hold_last(ev, _spec(ev), "value", initial=0.0, out="held").select("event_id", "event_type", "value", "held")


def integral(spark: SparkSession, sf: str) -> DataFrame:
    ev = _recorded(spark, sf)
    out = S.running_sum(ev, _spec(ev), F.col("value") * F.lit(0.5), "integral")
    return out.select("event_id", "event_type", F.round("integral", 4).alias("integral"))


def integral_exact(spark: SparkSession, sf: str) -> DataFrame:
    ev = _recorded(spark, sf)
    out = S.running_sum_exact(ev, _spec(ev), F.col("value") * F.lit(0.5), "integral")
    return out.select("event_id", "event_type", F.round("integral", 6).alias("integral"))


def pid_response(spark: SparkSession, sf: str) -> DataFrame:
    ev = _recorded(spark, sf)
    out = S.pid_response(ev, _spec(ev), pv="value", sv=50.0, cycle_time=0.5)
    return out.select(
        "event_id",
        "event_type",
        F.round("error", 6).alias("error"),
        F.round("integral", 4).alias("integral"),
        F.round("mv", 6).alias("mv"),
    )


def _unpivot_sql() -> str:
    parts = []
    for tag, src in LINEITEM_TAGS:
        inst = tag.split(".", 1)[0]
        parts.append(
            f"SELECT l_shipdate AS timestamp, '{tag}' AS param_name, CAST({src} AS DOUBLE) AS param_value, '{inst}' AS instance_name, "
            "CAST(l_orderkey AS INTEGER) AS cycle_count, CAST(l_orderkey * 0.5 AS DOUBLE) AS sim_time, l_orderkey, l_linenumber "
            f"FROM lineitem WHERE {src} IS NOT NULL"
        )
    body = " UNION ALL ".join(parts)
    return (
        "SELECT timestamp, param_name, param_value, instance_name, "
        "CASE WHEN regexp_matches(lower(instance_name), 'pid|controller|algorithm') THEN 'algorithm' "
        "WHEN regexp_matches(lower(instance_name), 'tank|valve|model') THEN 'model' ELSE 'variable' END AS param_type, "
        f"cycle_count, sim_time, l_orderkey, l_linenumber FROM ({body})"
    )


_W = "(PARTITION BY event_type ORDER BY ts, event_id)"
_WR = "(PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

ORACLE.update(
    {
        "ingest_unpivot": _unpivot_sql(),
        "ingest_allow_list": f"SELECT l_orderkey, l_linenumber, param_name, param_value, instance_name, param_type FROM ({_unpivot_sql()}) "
        "WHERE param_name IN ('pump.price', 'pid.tax')",
        "assign_ids": _with(
            "SELECT (SELECT coalesce(max(id), 0) FROM history) + row_number() OVER (ORDER BY timestamp, l_orderkey, l_linenumber, param_name) AS id, "
            f"l_orderkey, l_linenumber, param_name FROM ({_unpivot_sql()})"
        ),
        "lag_default": f"SELECT event_id, event_type, value, lag(value, 3, 0.0) OVER {_W} AS lag3 FROM events",
        "lag_one": f"SELECT event_id, event_type, lag(value, 1, 0.0) OVER {_W} AS lag1 FROM events",
        "lag_seeded": "SELECT event_id, event_type, CASE WHEN rn > 3 THEN lg WHEN rn = 3 THEN -1.0 ELSE 0.0 END AS lagx FROM "
        f"(SELECT event_id, event_type, lag(value, 3) OVER {_W} AS lg, row_number() OVER {_W} AS rn FROM events)",
        "hold_last": "SELECT event_id, event_type, value, coalesce(last_value(value IGNORE NULLS) OVER "
        f"{_WR}, 0.0) AS held FROM (SELECT event_id, ts, event_type, CASE WHEN value > 50 THEN NULL ELSE value END AS value FROM events)",
        "integral": f"SELECT event_id, event_type, round(sum(value * 0.5) OVER {_WR}, 4) AS integral FROM events",
        "integral_exact": f"SELECT event_id, event_type, round(sum(value * 0.5) OVER {_WR}, 6) AS integral FROM events",
        "pid_response": "SELECT event_id, event_type, round(e, 6) AS error, round(integral, 4) AS integral, "
        "round(greatest(0.0, least(100.0, 12.0 * e + 12.0 / 30.0 * integral + 12.0 * 0.15 * (e - e_prev) / 0.5)), 6) AS mv FROM ("
        f"SELECT event_id, event_type, e, sum(e * 0.5) OVER {_WR} AS integral, lag(e, 1, 0.0) OVER {_W} AS e_prev "
        "FROM (SELECT event_id, ts, event_type, 50.0 - value AS e FROM events))",
    }
)

QUERIES.update(
    {
        "ingest_unpivot": ingest_unpivot,
        "ingest_allow_list": ingest_allow_list,
        "assign_ids": assign_ids,
        "lag_default": lag_default,
        "lag_one": lag_one,
        "lag_seeded": lag_seeded,
        "hold_last": hold_last,
        "integral": integral,
        "integral_exact": integral_exact,
        "pid_response": pid_response,
    }
)


# --- greedy interval sampling (P1-P3, A4, J1) ----------------------------------

def sampled_query(spark: SparkSession, sf: str) -> DataFrame:
    h = events_history(spark, sf)
    return P.query_sampled(h, start_time=RANGE_START, end_time=RANGE_END, sample_interval=3600.0, limit=1000)


def sampled_instance(spark: SparkSession, sf: str) -> DataFrame:
    h = events_history(spark, sf)
    return P.query_sampled(h, instance_name=ONE_INSTANCE, sample_interval=3600.0, limit=1000)


def sampled_global(spark: SparkSession, sf: str) -> DataFrame:
    h = events_history(spark, sf)
    return P.query_sampled(h, sample_interval=600.0, limit=None)


def sampled_passthrough(spark: SparkSession, sf: str) -> DataFrame:
    h = events_history(spark, sf)
    return P.query_sampled(h, param_name=ONE_TAG, sample_interval=0.0, limit=1000)


def _sampled_sql(where: str, interval_s: int, limit: str) -> str:
    return (
        "WITH RECURSIVE " + HISTORY_SQL.strip() + ",\n"
        f"ts AS (SELECT DISTINCT timestamp AS t FROM history WHERE {where}),\n"
        "chain(t) AS (SELECT min(t) FROM ts UNION ALL "
        f"SELECT (SELECT min(ts.t) FROM ts WHERE ts.t >= chain.t + INTERVAL {interval_s} SECOND) FROM chain WHERE chain.t IS NOT NULL)\n"
        f"SELECT {HISTORY_COLS_SQL} FROM history WHERE {where} AND timestamp IN (SELECT t FROM chain WHERE t IS NOT NULL) "
        f"ORDER BY timestamp DESC, id DESC {limit}"
    )


# --- clock-derived columns (F5, F6, F9, P3) ------------------------------------

CLOCK_START = 1733479200.0  # 2024-12-06 10:00:00 UTC


def cycle_sample(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select((F.col("event_id") + 1).cast("int").alias("cycle_count"), "value")
    kept = P.stride_sample(ev, "cycle_count", cycle_time=0.5, sample_interval=5.0)
    st = C.sim_time("cycle_count", 0.5, CLOCK_START)
    return kept.select(
        "cycle_count",
        st.alias("sim_time"),
        C.time_text(st, "%Y-%m-%d %H:%M:%S").alias("time_str"),
        C.time_text(st).alias("time_iso"),
        "value",
    )


def overrun_flags(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    return ev.select("event_id", *C.overrun_flags(F.col("value") / F.lit(1000.0), cycle_time=0.5))


ORACLE.update(
    {
        "sampled_query": _sampled_sql(f"timestamp >= TIMESTAMP '{RANGE_START}' AND timestamp <= TIMESTAMP '{RANGE_END}'", 3600, "LIMIT 1000"),
        "sampled_instance": _sampled_sql(f"instance_name = '{ONE_INSTANCE}'", 3600, "LIMIT 1000"),
        "sampled_global": _sampled_sql("TRUE", 600, ""),
        "sampled_passthrough": _with(
            f"SELECT {HISTORY_COLS_SQL} FROM history WHERE param_name = '{ONE_TAG}' ORDER BY timestamp DESC, id DESC LIMIT 1000"
        ),
        "cycle_sample": "SELECT cycle_count, sim_time, strftime(make_timestamp(CAST(floor(sim_time * 1000000) AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS time_str, "
        "CASE WHEN CAST(floor(sim_time * 1000000) AS BIGINT) % 1000000 = 0 THEN strftime(make_timestamp(CAST(floor(sim_time * 1000000) AS BIGINT)), '%Y-%m-%dT%H:%M:%S') "
        "ELSE strftime(make_timestamp(CAST(floor(sim_time * 1000000) AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%f') END AS time_iso, value FROM ("
        f"SELECT CAST(event_id + 1 AS INTEGER) AS cycle_count, {CLOCK_START} + CAST(event_id + 1 AS DOUBLE) * 0.5 AS sim_time, value FROM events "
        "WHERE (event_id + 1) % 10 = 0)",
        "overrun_flags": "SELECT event_id, least(value / 1000.0 / 0.5, 1.0) AS exec_ratio, value / 1000.0 > 0.5 * 0.6 AS warn, "
        "value / 1000.0 >= 0.5 AS overrun FROM events",
    }
)

QUERIES.update(
    {
        "sampled_query": sampled_query,
        "sampled_instance": sampled_instance,
        "sampled_global": sampled_global,
        "sampled_passthrough": sampled_passthrough,
        "cycle_sample": cycle_sample,
        "overrun_flags": overrun_flags,
    }
)


# --- waveform datasets over a table-derived cycle index (G1-G5) ---------------

WAVE_CT = 0.5
WAVE_PERIOD = 7.3  # 14.6 cycles per period: not an integer
WAVE_LIST = ((10.0, 5.0), (20.0, 3.0), (0.0, 2.0), (7.0, 0.2))  # 10, 6, 4 and 1 cycles


def _index(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("i"))


def wave_sine(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).select("i", F.round(G.sine("i", 100.0, WAVE_PERIOD, 0.3, WAVE_CT), 9).alias("out"))


def wave_square(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).select("i", G.square("i", 5.0, WAVE_PERIOD, 0.25, WAVE_CT).alias("out"))


def wave_triangle(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).select("i", F.round(G.triangle("i", 100.0, WAVE_PERIOD, -0.1, WAVE_CT), 9).alias("out"))


def wave_list(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).select("i", G.list_wave("i", WAVE_LIST, WAVE_CT).alias("out"))


def wave_dataset(spark: SparkSession, sf: str) -> DataFrame:
    waves = {
        "sin1": G.Wave("sine", 100.0, WAVE_PERIOD, 0.3),
        "sq1": G.Wave("square", 5.0, WAVE_PERIOD, 0.25),
        "lw1": G.Wave("list", wave_list=WAVE_LIST),
    }
    wide = G.waves_over_index(_index(spark, sf), waves, "i", cycle_time=WAVE_CT, start_time=CLOCK_START, sample_interval=5.0, time_format="%Y/%m/%d %H:%M:%S")
    # Bare instance names mean their .out tag inside formulas
    wide = _formulas(wide, [("combo", "sin1 + sq1 * lw1")])
    return wide.select(
        "cycle_count",
        "need_sample",
        "time_str",
        "sim_time",
        F.round(F.col("`sin1.out`"), 9).alias("sin1_out"),
        F.col("`sq1.period`").alias("sq1_period"),
        F.round("combo", 9).alias("combo"),
    )


# --- math functions and formula columns (M1-M18) ------------------------------

def math_functions(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    r = lambda c, name, d=9: F.round(c, d).alias(name)
    return table(spark, sf, "events").select(
        "event_id",
        r(M.abs_(v - 250), "m_abs"),
        r(M.sqrt(v), "m_sqrt"),
        r(M.sin(v), "m_sin"),
        r(M.cos(v), "m_cos"),
        r(M.tan(v), "m_tan", 6),
        r(M.log(v), "m_ln"),
        r(M.log(v, 10), "m_log10"),
        r(M.exp(v / 100), "m_exp"),
        r(M.fabs(250 - v), "m_fabs"),
        r(M.asin(v / 500), "m_asin"),
        r(M.acos(v / 500), "m_acos"),
        r(M.atan(v), "m_atan"),
        M.floor(v * 1.5).alias("m_floor"),
        M.ceil(v * 1.5).alias("m_ceil"),
        M.min_(v, 100.0, v / 2 + 60).alias("m_min"),
        M.max_(v, 100.0).alias("m_max"),
        r(M.power(v, 0.5), "m_pow"),
        M.floordiv(v, 7.0).alias("m_floordiv"),
        r(M.pymod(v - 250, 7.0), "m_mod"),
        M.neg(v).alias("m_neg"),
    )


def formula_columns(spark: SparkSession, sf: str) -> DataFrame:
    ev = _recorded(spark, sf)
    out = _formulas(
        ev,
        [("y1", "sqrt(value) + `value[-2]` * 0.5"), ("y2", "y1 * 2 - least(value, 10.0)")],
        spec=_spec(ev),
        lags={"value": [2]},
    )
    return out.select("event_id", "event_type", F.round("y1", 9).alias("y1"), F.round("y2", 9).alias("y2"))


def formula_many_lags(spark: SparkSession, sf: str) -> DataFrame:
    ev = _recorded(spark, sf).withColumn("pump.half", F.col("value") / 2)
    out = _formulas(ev, [("y", "value[-1] - value[-2] + value[-5] * pump.half[-3]")], spec=_spec(ev), style="python")
    return out.select("event_id", "event_type", F.round("y", 6).alias("y"))


def formula_functions(spark: SparkSession, sf: str) -> DataFrame:
    ev = _recorded(spark, sf)
    out = _formulas(ev, [("a", "log(value, 10) + min(value, 3.0) + fabs(-value)"), ("b", "value % -7 + value // 7"), ("c", "max(a, b) ** 2")], style="python")
    return out.select("event_id", *[F.round(c, 6).alias(c) for c in "abc"])


def user_function(spark: SparkSession, sf: str) -> DataFrame:
    from tagloom.functions.registry import register_function

    register_function("twice_plus_one", lambda x: 2.0 * x + 1.0)
    out = _formulas(_recorded(spark, sf), [("y", "twice_plus_one(value) - 1")], style="python")
    return out.select("event_id", F.round("y", 9).alias("y"))


def _pmod(x: str, m: str) -> str:
    return f"(((({x}) % ({m})) + ({m})) % ({m}))"


_P = "CAST(14.6 AS DOUBLE)"
_I = "CAST(event_id AS DOUBLE)"
_POS = f"({_pmod(_I, _P)} / {_P})"
_SQPOS = _pmod(f"{_POS} + 0.25", "1.0")
_TRPOS = _pmod(f"{_POS} + -0.1", "1.0")
_LIST_CASE = "CAST(CASE WHEN event_id % 21 < 10 THEN 10.0 WHEN event_id % 21 < 16 THEN 20.0 WHEN event_id % 21 < 20 THEN 0.0 ELSE 7.0 END AS DOUBLE)"
_SIN = f"100.0 * sin(2 * pi() * {_POS} + 0.3)"
_SQ = f"CAST(CASE WHEN {_SQPOS} < 0.5 THEN 5.0 ELSE -5.0 END AS DOUBLE)"

ORACLE.update(
    {
        "wave_sine": f"SELECT event_id AS i, round({_SIN}, 9) AS out FROM events",
        "wave_square": f"SELECT event_id AS i, {_SQ} AS out FROM events",
        "wave_triangle": f"SELECT event_id AS i, round(CASE WHEN {_TRPOS} < 0.5 THEN -100.0 + 400.0 * {_TRPOS} "
        f"ELSE 100.0 - 400.0 * ({_TRPOS} - 0.5) END, 9) AS out FROM events",
        "wave_list": f"SELECT event_id AS i, {_LIST_CASE} AS out FROM events",
        "wave_dataset": "SELECT CAST(event_id + 1 AS INTEGER) AS cycle_count, (event_id + 1) % 10 = 0 AS need_sample, "
        f"strftime(make_timestamp(CAST(floor(({CLOCK_START} + CAST(event_id + 1 AS DOUBLE) * 0.5) * 1000000) AS BIGINT)), '%Y/%m/%d %H:%M:%S') AS time_str, "
        f"{CLOCK_START} + CAST(event_id + 1 AS DOUBLE) * 0.5 AS sim_time, round({_SIN}, 9) AS sin1_out, CAST(7.3 AS DOUBLE) AS sq1_period, "
        f"round({_SIN} + ({_SQ}) * ({_LIST_CASE}), 9) AS combo FROM events",
        "math_functions": "SELECT event_id, round(abs(value - 250), 9) AS m_abs, round(sqrt(value), 9) AS m_sqrt, round(sin(value), 9) AS m_sin, "
        "round(cos(value), 9) AS m_cos, round(tan(value), 6) AS m_tan, round(ln(value), 9) AS m_ln, round(ln(value) / ln(10.0), 9) AS m_log10, "
        "round(exp(value / 100), 9) AS m_exp, round(abs(250 - value), 9) AS m_fabs, round(asin(value / 500), 9) AS m_asin, "
        "round(acos(value / 500), 9) AS m_acos, round(atan(value), 9) AS m_atan, CAST(floor(value * 1.5) AS DOUBLE) AS m_floor, "
        "CAST(ceil(value * 1.5) AS DOUBLE) AS m_ceil, least(value, 100.0, value / 2 + 60) AS m_min, greatest(value, 100.0) AS m_max, "
        "round(pow(value, 0.5), 9) AS m_pow, CAST(floor(value / 7.0) AS DOUBLE) AS m_floordiv, "
        "round((value - 250) - 7.0 * floor((value - 250) / 7.0), 9) AS m_mod, -value AS m_neg FROM events",
        "formula_columns": "SELECT event_id, event_type, round(y1, 9) AS y1, round(y1 * 2 - least(value, 10.0), 9) AS y2 FROM ("
        f"SELECT event_id, event_type, value, sqrt(value) + lag(value, 2, 0.0) OVER {_W} * 0.5 AS y1 FROM events)",
    }
)

ORACLE["formula_many_lags"] = (
    "SELECT event_id, event_type, round(l1 - l2 + l5 * h3, 6) AS y FROM (SELECT event_id, event_type, "
    f"lag(value, 1, 0.0) OVER {_W} AS l1, lag(value, 2, 0.0) OVER {_W} AS l2, lag(value, 5, 0.0) OVER {_W} AS l5, lag(value / 2, 3, 0.0) OVER {_W} AS h3 FROM events)"
)
ORACLE["formula_functions"] = (
    "SELECT event_id, round(a, 6) AS a, round(b, 6) AS b, round(greatest(a, b) * greatest(a, b), 6) AS c FROM ("
    "SELECT event_id, log10(value) + least(value, 3.0) + value AS a, value + 7.0 * floor(value / -7.0) + floor(value / 7.0) AS b FROM events)"
)
ORACLE["user_function"] = "SELECT event_id, round(value + value, 9) AS y FROM events"

QUERIES.update({"formula_many_lags": formula_many_lags, "formula_functions": formula_functions, "user_function": user_function})

QUERIES.update(
    {
        "wave_sine": wave_sine,
        "wave_square": wave_square,
        "wave_triangle": wave_triangle,
        "wave_list": wave_list,
        "wave_dataset": wave_dataset,
        "math_functions": math_functions,
        "formula_columns": formula_columns,
    }
)


# --- template CSV and JSON envelope (S11-S17) ---------------------------------

def _wide_export(spark: SparkSession, sf: str) -> DataFrame:
    return wide_from_lineitem(table(spark, sf, "lineitem")).drop("timestamp")


def export_projection(spark: SparkSession, sf: str) -> DataFrame:
    proj = CSV.export_projection(_wide_export(spark, sf), CSV.load_template("ai_loop_tuning"), exclude=["l_orderkey", "l_linenumber"])
    return proj.drop("_order")


def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "csv-export")
    CSV.export_csv(_wide_export(spark, sf), path, "prediction", exclude=["l_orderkey", "l_linenumber"])
    back = CSV.read_template_csv(spark, path, "prediction")
    return back.select("time", *[F.col(f"`{c}`") for c in back.columns if c not in ("time", "time_text")])


#: time texts that no list of formats foresees, with the unit they are cut to
CSV_TIME_TEXTS = {"MMM d yyyy HH:mm": "minute", "yyyyMMdd HHmmss": "second", "MM/dd/yyyy h:mm a": "minute"}


def csv_time_formats(spark: SparkSession, sf: str) -> DataFrame:
    """One CSV a style of time text, each read back by the formats induced from it."""
    out = None
    for i, style in enumerate(CSV_TIME_TEXTS):
        path = scratch_path(spark, f"csv-times-{i}")
        ev = table(spark, sf, "events").select(F.date_format("ts", style).alias("time"), F.col("event_id").alias("EVENT"), F.col("value").alias("VALUE"))
        # the header is the first part file, the rows are written by all tasks
        header = spark.range(0, 1, 1, 1).select(*[F.lit(c).alias(c) for c in ev.columns])
        header.union(ev.select(*[F.col(c).cast("string") for c in ev.columns])).write.option("header", False).csv(path)
        back = CSV.read_template_csv(spark, path).select(F.lit(i).alias("style"), F.col("EVENT").cast("long").alias("event_id"), "time", F.col("VALUE").alias("value"))
        out = back if out is None else out.unionByName(back)
    return out


def _events_wide(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    k = J.decode_fields(ev, "k bigint", value="props", keep=["event_id", "ts", "value"])
    return k.select(
        (F.col("event_id") + 1).cast("int").alias("cycle_count"),
        ((F.col("event_id") + 1) * F.lit(0.5)).alias("sim_time"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time_str"),
        F.col("value").alias("pump.value"),
        F.col("k").cast("double").alias("pump.k"),
    )


def _events_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """The snapshots with text tags, one of them of digits."""
    kinds = table(spark, sf, "events").select((F.col("event_id") + 1).cast("int").alias("cycle_count"), F.col("event_type").alias("pump.kind"), F.col("user_id").cast("string").alias("pump.user"))
    return _events_wide(spark, sf).join(kinds, "cycle_count")


def envelope_tags(spark: SparkSession, sf: str) -> DataFrame:
    tags, _ = J.decode_envelope(J.encode_envelope(_events_mixed(spark, sf)), numeric_only=False)
    return J.discovered_tags(tags)


def json_decode(spark: SparkSession, sf: str) -> DataFrame:
    return J.decode_fields(table(spark, sf, "events"), "k bigint", value="props", keep=["event_id"])


def json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    texts = J.encode_envelope(_events_mixed(spark, sf))
    good, _ = J.decode_envelope(texts)
    return good.select("cycle_count", "sim_time", "datetime", "param_name", "param_value", "instance_name", "param_type")


def notification(spark: SparkSession, sf: str) -> DataFrame:
    return J.notification(_events_wide(spark, sf), keep=["cycle_count"])


_TXT = lambda c: f"CAST({c} AS VARCHAR)"
_SIM = "CAST(l_orderkey * 0.5 AS DOUBLE)"

ORACLE.update(
    {
        "export_projection": "SELECT strftime(make_timestamp(CAST(floor(" + _SIM + " * 1000000) AS BIGINT)), '%Y/%m/%d %H:%M:%S') AS \"Timestamp\", "
        + ", ".join(f"{_TXT(src)} AS \"{tag.upper()}\"" for tag, src in LINEITEM_TAGS)
        + ", l_returnflag AS \"PUMP.FLAG\" FROM lineitem",
        "csv_roundtrip": "SELECT make_timestamp(CAST(floor(" + _SIM + ") * 1000000 AS BIGINT)) AS time, "
        + ", ".join(f"CAST({src} AS DOUBLE) AS \"{tag.upper()}\"" for tag, src in LINEITEM_TAGS)
        + ", CAST(NULL AS DOUBLE) AS \"PUMP.FLAG\" FROM lineitem",
        "csv_time_formats": " UNION ALL ".join(
            f"SELECT CAST({i} AS INTEGER) AS style, event_id, CAST(date_trunc('{unit}', ts) AS TIMESTAMP) AS time, value FROM events" for i, unit in enumerate(CSV_TIME_TEXTS.values())
        ),
        "json_decode": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
        "json_roundtrip": "SELECT cycle_count, sim_time, datetime, param_name, param_value, 'pump' AS instance_name, 'variable' AS param_type FROM ("
        "SELECT CAST(event_id + 1 AS INTEGER) AS cycle_count, CAST((event_id + 1) * 0.5 AS DOUBLE) AS sim_time, strftime(ts, '%Y-%m-%d %H:%M:%S') AS datetime, "
        "'pump.value' AS param_name, value AS param_value FROM events UNION ALL "
        "SELECT CAST(event_id + 1 AS INTEGER), CAST((event_id + 1) * 0.5 AS DOUBLE), strftime(ts, '%Y-%m-%d %H:%M:%S'), 'pump.k', "
        "CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS DOUBLE) FROM events)",
        "envelope_tags": "SELECT t.param_name, 'pump' AS instance_name, 'variable' AS param_type, CAST((event_id + 1) * 0.5 AS DOUBLE) AS first_seen, "
        "CASE t.param_name WHEN 'pump.value' THEN value WHEN 'pump.k' THEN CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS initial_value "
        "FROM events, (VALUES ('pump.value'), ('pump.k'), ('pump.kind'), ('pump.user')) t(param_name) WHERE event_id = (SELECT min(event_id) FROM events)",
        "notification": "SELECT CAST(event_id + 1 AS INTEGER) AS cycle_count, '{\"timestamp\":' || CAST(CAST((event_id + 1) * 0.5 AS DOUBLE) AS VARCHAR) "
        "|| ',\"cycle_count\":' || CAST(event_id + 1 AS VARCHAR) || '}' AS value FROM events",
    }
)

QUERIES.update(
    {
        "export_projection": export_projection,
        "csv_roundtrip": csv_roundtrip,
        "csv_time_formats": csv_time_formats,
        "json_decode": json_decode,
        "json_roundtrip": json_roundtrip,
        "envelope_tags": envelope_tags,
        "notification": notification,
    }
)


# --- rate-limited recurrences (R1, R2) -------------------------------------------

def slew_limit(spark: SparkSession, sf: str) -> DataFrame:
    ev = _recorded(spark, sf)
    out = R.slew_limit(ev, _spec(ev), "value", 0.0, 100.0, full_travel_time=10.0, cycle_time=0.5, initial_opening=0.0, out="opening")
    return out.select("event_id", "event_type", F.round("opening", 9).alias("opening"))


ORACLE["slew_limit"] = (
    "WITH RECURSIVE r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn, "
    "greatest(CAST(0.0 AS DOUBLE), least(CAST(100.0 AS DOUBLE), value)) AS t FROM events),\n"
    "s(event_type, rn, c) AS (SELECT DISTINCT event_type, CAST(0 AS BIGINT), CAST(0.0 AS DOUBLE) FROM r UNION ALL "
    "SELECT s.event_type, s.rn + 1, greatest(CAST(0.0 AS DOUBLE), least(CAST(100.0 AS DOUBLE), CASE WHEN abs(r.t - s.c) <= 5.0 THEN r.t "
    "WHEN r.t - s.c > 0 THEN s.c + 5.0 ELSE s.c - 5.0 END)) FROM s JOIN r ON r.event_type = s.event_type AND r.rn = s.rn + 1)\n"
    "SELECT r.event_id, r.event_type, round(s.c, 9) AS opening FROM s JOIN r ON r.event_type = s.event_type AND r.rn = s.rn"
)

def slew_limit_slow(spark: SparkSession, sf: str) -> DataFrame:
    """A valve that takes a million seconds: no chunk forgets its entry."""
    ev = _recorded(spark, sf)
    out = R.slew_limit(ev, _spec(ev), "value", 0.0, 100.0, full_travel_time=1e6, cycle_time=0.5, initial_opening=0.0, out="opening")
    return out.select("event_id", "event_type", F.round("opening", 9).alias("opening"))


ORACLE["slew_limit_slow"] = ORACLE["slew_limit"].replace("5.0", "CAST(0.00005 AS DOUBLE)")

def step_program(spark: SparkSession, sf: str) -> DataFrame:
    """U2 in batch: the registered valve, step by step on the series layout."""
    ev = _recorded(spark, sf)
    out = run_program(ev, _spec(ev), "valve", {"target": "value"}, {"full_travel_time": 10.0, "cycle_time": 0.5})
    return out.select("event_id", "event_type", F.round("current_opening", 9).alias("opening"))


def program_total(spark: SparkSession, sf: str) -> DataFrame:
    """U2 in batch, associative form: the integral (W3) as a registered program, all chunks at once."""
    ev = _recorded(spark, sf)
    out = run_program(ev, _spec(ev), "total", {"value": "value"}, {"dt": 0.5})
    return out.select("event_id", "event_type", F.round("total", 4).alias("integral"))


ORACLE["step_program"] = ORACLE["slew_limit"]
ORACLE["program_total"] = ORACLE["integral"]

QUERIES.update({"slew_limit": slew_limit, "slew_limit_slow": slew_limit_slow, "step_program": step_program, "program_total": program_total})


# --- Structured Streaming (T1-T5): availableNow runs over the events table ------

def _stream_paths(spark: SparkSession, tag: str) -> tuple[str, str]:
    base = scratch_path(spark, f"stream-{tag}")
    return f"{base}/out", f"{base}/ckpt"


def _events_stream(spark: SparkSession, sf: str) -> DataFrame:
    from tagloom.streaming.ingest import read_table_stream

    return read_table_stream(spark, sf, "events")


def _stream_wide(ev: DataFrame) -> DataFrame:
    return ev.select(
        F.col("ts").alias("timestamp"),
        (F.col("event_id") + 1).cast("int").alias("cycle_count"),
        ((F.col("event_id") + 1) * F.lit(0.5)).alias("sim_time"),
        ((F.col("event_id") + 1) % 2 == 0).alias("need_sample"),
        F.col("value").alias("pump.value"),
        F.col("user_id").alias("valve1.user"),
        F.col("event_type").alias("pump.kind"),
    )


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    from tagloom.streaming.ingest import start_history_ingest

    out, ckpt = _stream_paths(spark, "ingest")
    start_history_ingest(_stream_wide(_events_stream(spark, sf)), out, ckpt, timestamp="timestamp").awaitTermination()
    return spark.read.parquet(out).select(*[c for c in ("id", "timestamp", "param_name", "param_value", "instance_name", "param_type", "cycle_count", "sim_time")])


def stream_latest(spark: SparkSession, sf: str) -> DataFrame:
    from tagloom.streaming.ingest import current_state, run_available

    out, ckpt = _stream_paths(spark, "latest")
    h = history_from_events(_events_stream(spark, sf))
    return run_available(current_state(h), out, ckpt, mode="complete").select("param_name", "param_value", "timestamp")


def stream_new_tags(spark: SparkSession, sf: str) -> DataFrame:
    from tagloom.streaming.ingest import new_tags, run_available

    out, ckpt = _stream_paths(spark, "newtags")
    h = history_from_events(_events_stream(spark, sf))
    return run_available(new_tags(h), out, ckpt, mode="complete").select("param_name", "instance_name", "param_type", "first_seen", "initial_value")


def stream_notification(spark: SparkSession, sf: str) -> DataFrame:
    from tagloom.streaming.ingest import notifications, run_available

    out, ckpt = _stream_paths(spark, "notify")
    ev = _events_stream(spark, sf).select((F.col("event_id") + 1).cast("int").alias("cycle_count"), ((F.col("event_id") + 1) * F.lit(0.5)).alias("sim_time"))
    return run_available(notifications(ev), out, ckpt)


def _keyed(spark: SparkSession, sf: str, tag: str, prog: str, inputs: dict, params: dict, outputs: dict | None = None) -> DataFrame:
    from tagloom.operators.sampling import micros
    from tagloom.streaming.ingest import keyed_state, run_available, with_closing

    out, ckpt = _stream_paths(spark, tag)
    ev = with_closing(_events_stream(spark, sf).withColumn("us", micros("ts")), "us", f"{out}-closing")
    res = keyed_state(ev, prog, ["event_type"], "us", inputs, params, passthrough=["event_id"], output_types=outputs, tie_break=["event_id"])
    # a store for each core: a store a shuffle partition costs more to open than the rows to step
    cores = spark.sparkContext.defaultParallelism
    return run_available(res, out, ckpt, closing=("us", f"{out}-closing"), state_partitions=min(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def stream_slew(spark: SparkSession, sf: str) -> DataFrame:
    res = _keyed(spark, sf, "slew", "VALVE", {"target": "value"}, {"full_travel_time": 10.0, "cycle_time": 0.5})
    return res.select("event_id", "event_type", F.round("current_opening", 9).alias("opening"))


def stream_lag(spark: SparkSession, sf: str) -> DataFrame:
    res = _keyed(spark, sf, "lag", "LAG", {"value": "value"}, {"n": 3, "default": 0.0})
    return res.select("event_id", "event_type", F.col("lagged").alias("lag3"))


def stream_sampler(spark: SparkSession, sf: str) -> DataFrame:
    res = _keyed(spark, sf, "sampler", "SAMPLER", {}, {"interval_us": 3600 * 1_000_000}, {"kept": "boolean"})
    return res.filter("kept").select("event_id", "event_type")


ORACLE.update(
    {
        "stream_ingest": "SELECT row_number() OVER (ORDER BY timestamp, param_name) AS id, timestamp, param_name, param_value, split_part(param_name, '.', 1) AS instance_name, "
        "CASE WHEN param_name LIKE 'valve%' THEN 'model' ELSE 'variable' END AS param_type, cycle_count, sim_time FROM (SELECT ts AS timestamp, 'pump.value' AS param_name, value AS param_value, "
        "CAST(event_id + 1 AS INTEGER) AS cycle_count, CAST((event_id + 1) * 0.5 AS DOUBLE) AS sim_time FROM events WHERE (event_id + 1) % 2 = 0 "
        "UNION ALL SELECT ts, 'valve1.user', CAST(user_id AS DOUBLE), CAST(event_id + 1 AS INTEGER), CAST((event_id + 1) * 0.5 AS DOUBLE) "
        "FROM events WHERE (event_id + 1) % 2 = 0) u",
        "stream_latest": _with(
            "SELECT param_name, param_value, timestamp FROM (SELECT param_name, param_value, timestamp, row_number() OVER "
            "(PARTITION BY param_name ORDER BY timestamp DESC, id DESC) AS rn FROM history) WHERE rn = 1"
        ),
        "stream_new_tags": _with("SELECT param_name, instance_name, param_type, min(timestamp) AS first_seen, arg_min(param_value, (timestamp, id)) AS initial_value FROM history GROUP BY ALL"),
        "stream_notification": ORACLE["notification"],
        "stream_slew": ORACLE["slew_limit"],
        "stream_lag": ORACLE["lag_default"].replace("event_id, event_type, value, lag(", "event_id, event_type, lag("),
        "stream_sampler": "WITH RECURSIVE s(event_type, t) AS (SELECT event_type, min(ts) FROM events GROUP BY event_type UNION ALL "
        "SELECT s.event_type, (SELECT min(e.ts) FROM events e WHERE e.event_type = s.event_type AND e.ts >= s.t + INTERVAL 3600 SECOND) "
        "FROM s WHERE s.t IS NOT NULL)\n"
        "SELECT e.event_id, e.event_type FROM events e JOIN s ON e.event_type = s.event_type AND e.ts = s.t",
    }
)

QUERIES.update(
    {
        "stream_ingest": stream_ingest,
        "stream_latest": stream_latest,
        "stream_new_tags": stream_new_tags,
        "stream_notification": stream_notification,
        "stream_slew": stream_slew,
        "stream_lag": stream_lag,
        "stream_sampler": stream_sampler,
    }
)


# --- history table sink/scan (S1, S10) and tag selection (F7) ----------------------

def history_table_query(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "history")
    write_history(events_history(spark, sf), path, mode="append")
    h = read_history(spark, path)
    return Q.query_history(h, instance_name=ONE_INSTANCE, start_time=RANGE_START, end_time=RANGE_END, limit=1000)


def history_tag_filter(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "history")
    write_history(events_history(spark, sf), path, cluster="curve")
    return Q.query_history(read_history(spark, path), param_name=ONE_TAG, limit=None)


def _appended(spark: SparkSession, sf: str) -> str:
    """History written by two appends, which keep the rollup."""
    path = scratch_path(spark, "rolled")
    rows = events_history(spark, sf).drop("id")
    for late in (False, True):
        append_history(rows.filter((F.col("timestamp") >= F.lit(RANGE_END).cast("timestamp_ntz")) == late), path)
    return path


def history_newest(spark: SparkSession, sf: str) -> DataFrame:
    return Q.query_history(read_history(spark, _appended(spark, sf)), limit=1000).select("timestamp", "param_name", "param_value")


def statistics_rollup(spark: SparkSession, sf: str) -> DataFrame:
    found = rollup.statistics_rollup(spark, _appended(spark, sf), RANGE_START, RANGE_END)
    return found.select("param_name", "count", "min", "max", F.round("avg", 4).alias("avg"), F.round("sum", 4).alias("sum"))


def latest_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.latest_rollup(spark, _appended(spark, sf))


def append_two_batches(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "append")
    rows = events_history(spark, sf).drop("id")
    for late in (False, True):  # the second append goes on with the ids of the first
        append_history(rows.filter((F.col("timestamp") >= F.lit(RANGE_END).cast("timestamp_ntz")) == late), path)
    return read_history(spark, path).select("id", "timestamp", "param_name", "param_value")


def tag_selection(spark: SparkSession, sf: str) -> DataFrame:
    wide = wide_from_lineitem(table(spark, sf, "lineitem"))
    return Q.select_tags(wide, ["pump.price", "no.such_tag", "pid.tax"], time_column="timestamp").toDF("timestamp", "pump_price", "pid_tax")


ORACLE.update(
    {
        "history_table_query": _with(
            f"SELECT {HISTORY_COLS_SQL} FROM history WHERE instance_name = '{ONE_INSTANCE}' AND timestamp >= TIMESTAMP '{RANGE_START}' "
            f"AND timestamp <= TIMESTAMP '{RANGE_END}' ORDER BY timestamp DESC, id DESC LIMIT 1000"
        ),
        "tag_selection": "SELECT l_shipdate AS timestamp, l_extendedprice AS pump_price, l_tax AS pid_tax FROM lineitem",
    }
)

ORACLE["history_tag_filter"] = _with(f"SELECT {HISTORY_COLS_SQL} FROM history WHERE param_name = '{ONE_TAG}'")
ORACLE["history_newest"] = _with("SELECT timestamp, param_name, param_value FROM history ORDER BY timestamp DESC, param_name DESC, cycle_count DESC LIMIT 1000")
ORACLE["statistics_rollup"] = _with(
    f"SELECT param_name, count(*) AS count, min(param_value) AS min, max(param_value) AS max, round(avg(param_value), 4) AS avg, round(sum(param_value), 4) AS sum "
    f"FROM history WHERE timestamp >= TIMESTAMP '{RANGE_START}' AND timestamp <= TIMESTAMP '{RANGE_END}' GROUP BY param_name"
)
ORACLE["latest_rollup"] = _with(
    "SELECT param_name, param_value, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY param_name ORDER BY timestamp DESC, cycle_count DESC) AS rn FROM history) WHERE rn = 1"
)
ORACLE["append_history"] = _with("SELECT row_number() OVER (ORDER BY timestamp, param_name, cycle_count) AS id, timestamp, param_name, param_value FROM history")

QUERIES.update({"history_table_query": history_table_query, "tag_selection": tag_selection, "history_tag_filter": history_tag_filter, "append_history": append_two_batches})
QUERIES.update({"history_newest": history_newest, "statistics_rollup": statistics_rollup, "latest_rollup": latest_rollup})

FLAGSHIP = "sampled_query"
