"""T1-T5 on Structured Streaming.

* T1 ``start_history_ingest``: snapshot stream -> S2-S8 -> ids (S9) -> history
  parquet, in ``foreachBatch``. Each epoch writes its own partition folder in
  dynamic overwrite mode and records its id range in a small ledger, so a
  replayed epoch rewrites the same rows with the same ids (exactly-once output
  on restart from the checkpoint).
* T2 ``current_state``: latest value per tag, complete mode (state = tag count).
* T3 ``notifications``: S17 projection of every snapshot.
* T4 ``new_tags``: first sighting of each tag in event time (a grouped minimum).
* T5 ``keyed_state`` (:mod:`tagloom.streaming.keyed`): a registered step program per series.
"""

from __future__ import annotations

import contextlib
import datetime as _dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tagloom.operators.ingest import assign_ids, snapshots_to_history
from tagloom.operators.query import time_id_key
from tagloom.sources.envelope import notification
from tagloom.sources.history import path_exists, storage_columns
from tagloom.streaming.keyed import close, keyed_state, rocksdb, with_closing  # noqa: F401  (T5 is part of this module's interface)


def read_table_stream(spark: SparkSession, sf_dir: str, name: str, schema: T.StructType | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """A driver table, one file or a folder of part files, as a file stream."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = schema or spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    path = path[:-1] + "[t]"  # as a glob the path may be a file as well as a folder
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


# --- T1 ----------------------------------------------------------------------------

def _ledger_path(sink: str) -> str:
    return sink.rstrip("/") + "/_id_ledger"


_LEDGER = "first_id long, rows long, stamp string, epoch long"


def _ledger(spark: SparkSession, sink: str) -> DataFrame | None:
    if not path_exists(spark, _ledger_path(sink)):
        return None  # no ledger yet; any other failure to read it is an error
    return spark.read.schema(_LEDGER).parquet(_ledger_path(sink))


def _next_id(spark: SparkSession, sink: str, epoch: int) -> int:
    led = _ledger(spark, sink)
    row = led.filter(F.col("epoch") < epoch).agg(F.max(F.col("first_id") + F.col("rows")).alias("n")).first() if led is not None else None
    return int(row["n"]) if row and row["n"] is not None else 1


def _stamp(spark: SparkSession, sink: str, epoch: int) -> str:
    """Wall clock (UTC) of an epoch's first try: what its ledger row says, now if it has none."""
    led = _ledger(spark, sink)
    row = led.filter((F.col("epoch") == epoch) & F.col("stamp").isNotNull()).select("stamp").first() if led is not None else None
    return row["stamp"] if row else _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None).isoformat(sep=" ")


def history_batch_writer(sink: str, order: Sequence[str] = ("timestamp", "param_name", "cycle_count", "sim_time", "param_value"), stored_variables=None, timestamp: str | None = "timestamp"):
    """``foreachBatch`` body for T1 (usable on its own for replay tests).

    The default order is unique but for equal rows, so a replay gives the same rows
    the same ids. Snapshots without a time column get the wall clock of the epoch's
    first try: it goes into the ledger before the rows are written, and a replay,
    on another day or in another zone, reads it back.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        timed = bool(timestamp) and timestamp in batch.columns
        stamp = None if timed else _stamp(spark, sink, epoch)
        ts = timestamp if timed else F.lit(stamp).cast("timestamp_ntz")
        long = snapshots_to_history(batch, ts, stored_variables=stored_variables)
        n = long.count()
        if n == 0:
            return
        start = _next_id(spark, sink, epoch)
        # one tiny row an epoch, before its rows: a replay finds the same first id and time
        ledger = spark.createDataFrame([(int(start), int(n), stamp)], "first_id long, rows long, stamp string")
        ledger.write.mode("overwrite").parquet(f"{_ledger_path(sink)}/epoch={int(epoch)}")
        out = storage_columns(assign_ids(long, list(order), start=start)).withColumn("epoch", F.lit(int(epoch)))
        (
            out.repartitionByRange("date", "param_name", "timestamp")
            .sortWithinPartitions("date", "param_name", "timestamp")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("date", "epoch")
            .parquet(sink)
        )

    return write


def start_history_ingest(
    snapshots: DataFrame,
    sink: str,
    checkpoint_location: str,
    timestamp: str | None = "timestamp",
    trigger: Mapping[str, object] | None = None,
    stored_variables=None,
) -> StreamingQuery:
    """Continuous wide-snapshot ingest into the history table (``trigger`` e.g. ``{"processingTime": "0.5 seconds"}``)."""
    w = snapshots.writeStream.foreachBatch(history_batch_writer(sink, stored_variables=stored_variables, timestamp=timestamp)).option(
        "checkpointLocation", checkpoint_location
    )
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


# --- T2, T3, T4 ----------------------------------------------------------------------

def current_state(history: DataFrame) -> DataFrame:
    """Latest value per tag (highest (timestamp, id) wins); run in complete or update mode."""
    return history.groupBy("param_name").agg(
        F.max_by("param_value", time_id_key()).alias("param_value"),
        F.max("timestamp").alias("timestamp"),
    )


def notifications(snapshots: DataFrame) -> DataFrame:
    """The notification JSON of every snapshot."""
    return notification(snapshots, keep=["cycle_count"] if "cycle_count" in snapshots.columns else [])


def new_tags(history: DataFrame) -> DataFrame:
    """T4: first sighting of each tag in event time, whatever the order of arrival; run in complete or update mode.

    State is one row per tag (bounded by the tag count).
    """
    key = time_id_key() if "id" in history.columns else F.struct("timestamp", "param_value")
    return history.groupBy("param_name", "instance_name", "param_type").agg(
        F.min("timestamp").alias("first_seen"),
        F.min_by("param_value", key).alias("initial_value"),
    )


def run_available(df: DataFrame, path: str, checkpoint_location: str, mode: str = "append", closing: tuple[str, str] | None = None, state_partitions: int | None = None) -> DataFrame:
    """Drive a streaming frame to completion (availableNow) into parquet at ``path``; return it as a table.

    Append mode uses the file sink (exactly-once via its commit log); complete /
    update modes overwrite ``path`` with each epoch's result in ``foreachBatch``.
    ``closing`` = (time column, folder) of :func:`with_closing`: the query runs a
    second time after the closing row, which releases the rows that still wait;
    ``state_partitions`` are those of its state, by default the session's.
    """
    spark = df.sparkSession
    w = df.writeStream.option("checkpointLocation", checkpoint_location).trigger(availableNow=True).outputMode(mode)
    w = w.format("parquet").option("path", path) if mode == "append" else w.foreachBatch(lambda b, _e: b.write.mode("overwrite").parquet(path))
    with rocksdb(spark, state_partitions) if closing else contextlib.nullcontext():
        w.start().awaitTermination()
        if closing:
            close(spark, *closing)
            w.start().awaitTermination()
    return spark.read.parquet(path)
