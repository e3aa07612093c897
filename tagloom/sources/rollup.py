"""Statistics and latest values from daily partials of a stored history table.

``<history>/_rollup`` holds one row a tag, day and appended batch: count, sum, least
and greatest value, and the newest row. All of these merge, so a query over a time
range adds up whole days from the rollup and scans the rows of the two edge days
only; what it costs follows the number of tags and days, not of rows.

``append_history`` keeps it up to date: it notes a batch's ids in
``<history>/_batches`` before it writes the rows and adds the partials after. A batch
that is noted but not in the rollup (a failure in between) is read from its rows by
every query until the next append, or :func:`extend`, adds it. :func:`rebuild` makes
both from the rows of a table that was written otherwise.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators.query import _lit_ts, time_id_key

_BATCH = "first_id long, rows long"
_PARTIAL = "param_name string, instance_name string, count long, sum double, min double, max double, last_key decimal(38,0), last_value double, last_time timestamp_ntz, batch long, date date"


def _batches_path(path: str) -> str:
    return f"{path.rstrip('/')}/_batches"


def _rollup_path(path: str) -> str:
    return f"{path.rstrip('/')}/_rollup"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    from tagloom.sources.history import path_exists

    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def note_batch(spark: SparkSession, path: str, first_id: int, rows: int) -> None:
    """One row: the ids ``first_id ... first_id + rows - 1`` are about to be appended."""
    if rows:
        spark.createDataFrame([(int(first_id), int(rows))], _BATCH).coalesce(1).write.mode("append").parquet(_batches_path(path))


def _missing(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(first id, end) of the noted batches that the rollup lacks. A batch noted again with the same first id replaces one that failed."""
    noted = _read(spark, _batches_path(path), _BATCH).groupBy("first_id").agg(F.max("rows").alias("rows"))
    there = _read(spark, _rollup_path(path), _PARTIAL).select(F.col("batch").alias("first_id")).distinct()
    return sorted((r["first_id"], r["first_id"] + r["rows"]) for r in noted.join(there, "first_id", "left_anti").collect())


def partials(rows: DataFrame, *keys: str) -> DataFrame:
    """Mergeable partials of history rows by tag and ``keys``."""
    key = time_id_key()
    return rows.groupBy("param_name", "instance_name", *keys).agg(
        F.count(F.lit(1)).alias("count"), F.sum("param_value").alias("sum"), F.min("param_value").alias("min"), F.max("param_value").alias("max"),
        F.max(key).alias("last_key"), F.max_by("param_value", key).alias("last_value"), F.max("timestamp").alias("last_time"),
    )


def merged(parts: DataFrame, *keys: str) -> DataFrame:
    """Partials of the same ``keys`` as one."""
    return parts.groupBy(*keys).agg(
        F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.max("last_key").alias("last_key"), F.max_by("last_value", "last_key").alias("last_value"), F.max("last_time").alias("last_time"),
    )


def _ids_within(ranges: list[tuple[int, int]]) -> Column:
    inside = F.lit(False)
    for first, end in ranges:
        inside = inside | F.col("id").between(F.lit(first), F.lit(end - 1))
    return inside


def extend(spark: SparkSession, path: str) -> None:
    """Add the partials of all noted batches that the rollup lacks, each from its own ids."""
    from tagloom.sources.history import read_history

    for first, end in _missing(spark, path):
        rows = read_history(spark, path).where(_ids_within([(first, end)]))
        out = partials(rows, "date").withColumn("batch", F.lit(first).cast("long"))
        # a day's partials are few: one file a day and batch
        out.repartition("date").sortWithinPartitions("param_name").write.mode("append").partitionBy("date").parquet(_rollup_path(path))


def rebuild(spark: SparkSession, path: str) -> None:
    """Note all rows of the table as one batch and write its partials, whatever was there."""
    from tagloom.sources.history import read_history

    ids = read_history(spark, path).agg(F.min("id").alias("a"), F.max("id").alias("b")).first()
    batches = [(int(ids["a"]), int(ids["b"] - ids["a"] + 1))] if ids["a"] is not None else []
    spark.createDataFrame(batches, _BATCH).coalesce(1).write.mode("overwrite").parquet(_batches_path(path))
    spark.createDataFrame([], _PARTIAL).write.mode("overwrite").partitionBy("date").parquet(_rollup_path(path))
    extend(spark, path)


def _day(value) -> tuple[_dt.datetime, _dt.date]:
    at = _dt.datetime.fromisoformat(value) if isinstance(value, str) else value
    return at, at.date()


def range_partials(spark: SparkSession, path: str, start_time=None, end_time=None) -> DataFrame:
    """Partials of the rows between two inclusive times: whole days from the rollup, the edge days from their rows."""
    from tagloom.sources.history import read_history

    history, days = read_history(spark, path), _read(spark, _rollup_path(path), _PARTIAL)
    whole, edges, inside = F.lit(True), [], F.lit(True)
    if start_time:
        at, day = _day(start_time)
        inside = inside & (F.col("timestamp") >= _lit_ts(start_time))
        if at.time() != _dt.time(0):
            edges.append(day)
            day += _dt.timedelta(days=1)
        whole = whole & (F.col("date") >= F.lit(day))
    if end_time:
        at, day = _day(end_time)
        inside = inside & (F.col("timestamp") <= _lit_ts(end_time))
        edges.append(day)  # unless it ends with the last microsecond
        whole = whole & (F.col("date") < F.lit(day))
    columns = ["param_name", "instance_name", "count", "sum", "min", "max", "last_key", "last_value", "last_time"]
    out = days.where(whole).select(*columns)
    if edges:
        out = out.unionByName(partials(history.where(F.col("date").isin(sorted(set(edges))) & inside)).select(*columns))
    if missing := _missing(spark, path):
        out = out.unionByName(partials(history.where(whole & inside & _ids_within(missing))).select(*columns))
    return out


def statistics_rollup(spark: SparkSession, path: str, start_time=None, end_time=None) -> DataFrame:
    """A1 for every tag from the rollup: ``param_name, count, min, max, avg, sum``."""
    found = merged(range_partials(spark, path, start_time, end_time), "param_name")
    return found.select("param_name", "count", "min", "max", (F.col("sum") / F.col("count")).alias("avg"), "sum")


def latest_rollup(spark: SparkSession, path: str, instance_name: str | None = None) -> DataFrame:
    """A3 from the rollup: the latest value of every tag, optionally within one instance."""
    parts = range_partials(spark, path)
    found = merged(parts.where(F.col("instance_name") == instance_name) if instance_name else parts, "param_name")
    return found.select("param_name", F.col("last_value").alias("param_value"), F.col("last_time").alias("timestamp"))
