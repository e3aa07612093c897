"""History table source/sink and the driver-table fixtures.

Storage layout for scale: parquet partitioned by ``date`` (derived from the
timestamp) and clustered inside files, by tag and time or along a curve through
both, so that tag and time predicates prune partitions and skip row groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.operators.ingest import assign_ids, classify_instance, instance_of, max_id
from tagloom.operators.splits import split_points
from tagloom.schema import HISTORY_COLUMNS, HISTORY_SCHEMA


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """S1 scan with the fixed schema, and two derived columns for pruning: ``date`` (the partition) and ``epoch_us``.

    Parquet readers compare no zone-less timestamps with a row group's bounds, so
    the time is stored as a BIGINT as well; it is null in files that lack it.
    """
    schema = T.StructType(list(HISTORY_SCHEMA.fields) + [T.StructField("epoch_us", T.LongType()), T.StructField("date", T.DateType())])
    return spark.read.schema(schema).parquet(path)


def storage_columns(history: DataFrame) -> DataFrame:
    """The stored columns of history rows: the fixed schema, ``epoch_us`` and ``date``."""
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("timestamp"))
    return history.select(*HISTORY_COLUMNS, us.alias("epoch_us"), F.to_date("timestamp").alias("date"))


#: cells a side of the (tag, time of day) curve, as bits
CURVE_BITS = 6


def _interleave(a: Column, b: Column, bits: int = CURVE_BITS) -> Column:
    """Place on the Z-order curve of two cell numbers below ``2^bits``."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        for j, cell in ((2 * i + 1, a), (2 * i, b)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(cell, i).bitwiseAND(F.lit(1).cast("long")), j))
    return out


def curve_place(history: DataFrame) -> Column:
    """Place of a row on the (tag, time of day) curve: tags by split points of the table, the day in equal cells."""
    cells = 1 << CURVE_BITS
    tag = split_points(history, ["param_name"], cells).index()
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    micros = F.pmod(F.timestamp_diff("MICROSECOND", epoch, F.col("timestamp")), F.lit(86_400_000_000))
    return _interleave(tag, F.floor(micros * F.lit(cells) / F.lit(86_400_000_000)).cast("long"))


def write_history(history: DataFrame, path: str, mode: str = "append", cluster: str = "tag", tags: int | None = None, group_rows: int | None = None) -> None:
    """S10 sink: partitioned by date, clustered inside each file, with a Bloom filter of the tags of each row group.

    ``cluster="tag"`` sorts by tag, then time: best where queries name a tag.
    ``"curve"`` follows a Z-order curve through (tag, time of day): a query by tag, one
    by a part of the day, and one by both all skip most row groups. The filter serves
    files whose groups hold many tags (``tags`` distinct ones, about); where a group's
    tags fit its dictionary that is looked up instead. ``group_rows`` bounds the rows
    of a row group. Spark's task commit is all-or-nothing per job, so a failed append
    leaves nothing behind and raises (the reference drops the batch silently).
    """
    if cluster not in ("tag", "curve"):
        raise ValueError(f"cluster by 'tag' or 'curve', not {cluster!r}")
    out = storage_columns(history)
    keys = ["date", "param_name", "timestamp"]
    if cluster == "curve":
        out, keys = out.withColumn("_place", curve_place(out)), ["date", "_place", "param_name", "timestamp"]
    # a dense day is written by many tasks
    writer = out.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_place").write.mode(mode).partitionBy("date")
    writer = writer.option("parquet.bloom.filter.enabled#param_name", "true")
    if tags:
        writer = writer.option("parquet.bloom.filter.expected.ndv#param_name", str(tags))
    if group_rows:
        writer = writer.option("parquet.block.row.count.limit", str(group_rows))
    writer.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def append_history(rows: DataFrame, path: str, order: tuple = ("timestamp", "param_name", "cycle_count", "sim_time", "param_value")) -> None:
    """S9 and S10 in one call: number long rows after the ids already stored at ``path``, append them, and extend the rollup.

    The default order is unique but for equal rows. The ids of the batch are noted
    before its rows are written, and its rollup after them, so that a query can tell
    which rows a rollup lacks (:mod:`tagloom.sources.rollup`).
    """
    from tagloom.sources import rollup

    spark = rows.sparkSession
    start = max_id(read_history(spark, path) if path_exists(spark, path) else None) + 1
    numbered = assign_ids(rows, list(order), start=start)
    rollup.note_batch(spark, path, start, rows.count())
    write_history(numbered, path, mode="append")
    rollup.extend(spark, path)


def events_tag(event_type: Column, user_id: Column) -> Column:
    """Tag name of the ``events`` history fixture (``error`` events become bare tags)."""
    inst = F.concat(
        F.when(user_id % 4 == 0, F.lit("pid"))
        .when(user_id % 4 == 1, F.lit("tank"))
        .when(user_id % 4 == 2, F.lit("valve"))
        .otherwise(F.lit("sensor")),
        (user_id % 16).cast("string"),
    )
    return F.when(event_type == "error", F.lit("error")).otherwise(F.concat(inst, F.lit("."), event_type))


def _truncate_hour(ts: Column) -> Column:
    """Zone-free hour truncation of a TIMESTAMP_NTZ (``date_trunc`` would go through the session zone)."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    us = F.timestamp_diff("MICROSECOND", epoch, ts)
    return F.timestamp_add("MICROSECOND", F.floor(us / F.lit(3_600_000_000)) * F.lit(3_600_000_000), epoch)


def history_from_events(events: DataFrame, hour_ties: bool = False) -> DataFrame:
    """History view over the driver ``events`` table (the fixture every query key uses).

    ``id = event_id + 1``, ``cycle_count = event_id + 1``, ``sim_time = 0.5 * cycle``;
    instance and type come from the same tag rules as ingest. ``hour_ties``
    truncates timestamps to the hour (the tie fixture).
    """
    tag = events_tag(F.col("event_type"), F.col("user_id"))
    ts = _truncate_hour(F.col("ts")) if hour_ties else F.col("ts")
    return events.select(
        (F.col("event_id") + 1).cast("long").alias("id"),
        ts.alias("timestamp"),
        tag.alias("param_name"),
        F.col("value").cast("double").alias("param_value"),
        instance_of(tag).alias("instance_name"),
        classify_instance(instance_of(tag)).alias("param_type"),
        (F.col("event_id") + 1).cast("int").alias("cycle_count"),
        ((F.col("event_id") + 1) * F.lit(0.5)).cast("double").alias("sim_time"),
    )


def events_history(spark: SparkSession, sf_dir: str, hour_ties: bool = False) -> DataFrame:
    return history_from_events(table(spark, sf_dir, "events"), hour_ties=hour_ties)


# The wide-snapshot fixture over lineitem (tag name -> source column).
LINEITEM_TAGS = (
    ("pump.quantity", "l_quantity"),
    ("pump.price", "l_extendedprice"),
    ("pid.discount", "l_discount"),
    ("pid.tax", "l_tax"),
)


def wide_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Wide snapshot rows from ``lineitem``: four numeric tags plus a string tag that ingest must drop.

    ``need_sample`` is true on every row; timestamp = ship date; cycle = order key.
    """
    return lineitem.select(
        F.col("l_orderkey"),
        F.col("l_linenumber"),
        F.col("l_shipdate").alias("timestamp"),
        F.col("l_orderkey").cast("int").alias("cycle_count"),
        (F.col("l_orderkey") * F.lit(0.5)).cast("double").alias("sim_time"),
        F.lit(True).alias("need_sample"),
        *[F.col(src).alias(tag) for tag, src in LINEITEM_TAGS],
        F.col("l_returnflag").alias("pump.flag"),
    )
