"""Fixed schemas and constants of the tag history model."""

from __future__ import annotations

from pyspark.sql import types as T

# Snapshot metadata keys, never treated as tags.
METADATA_KEYS = ("cycle_count", "need_sample", "time_str", "sim_time", "exec_ratio")

# Tag type classification, first matching group wins
# (substring test on the lower-cased instance name).
ALGORITHM_MARKERS = ("pid", "controller", "algorithm")
MODEL_MARKERS = ("tank", "valve", "model")
UNKNOWN_INSTANCE = "unknown"

# Long history record (one row per tag per sampled cycle).
HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("timestamp", T.TimestampNTZType(), False),
        T.StructField("param_name", T.StringType(), False),
        T.StructField("param_value", T.DoubleType(), False),
        T.StructField("instance_name", T.StringType(), False),
        T.StructField("param_type", T.StringType(), True),
        T.StructField("cycle_count", T.IntegerType(), True),
        T.StructField("sim_time", T.DoubleType(), True),
    ]
)
HISTORY_COLUMNS = [f.name for f in HISTORY_SCHEMA.fields]

# Realtime JSON envelope and notification.
ENVELOPE_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("datetime", T.StringType()),
        T.StructField("cycle_count", T.IntegerType()),
        T.StructField("sim_time", T.DoubleType()),
        T.StructField("params", T.MapType(T.StringType(), T.DoubleType())),
    ]
)
NOTIFICATION_SCHEMA = T.StructType(
    [T.StructField("timestamp", T.DoubleType()), T.StructField("cycle_count", T.IntegerType())]
)

# Clock defaults.
DEFAULT_CYCLE_TIME = 0.5
WARN_EXEC_FRACTION = 0.6
