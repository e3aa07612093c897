"""Realtime JSON snapshot envelope and notification.

Encode: ``to_json(struct(timestamp, datetime, cycle_count, sim_time, params))``
with ``params`` an object of every non-metadata tag, whatever its type. Decode:
``from_json`` in PERMISSIVE mode with variant tag values; malformed JSON and
envelopes without (or with empty) ``params`` go to the rejected side, good ones
explode to one row per tag.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.operators.ingest import classify_instance, instance_of
from tagloom.schema import ENVELOPE_SCHEMA, METADATA_KEYS, NOTIFICATION_SCHEMA


def snapshot_tags(wide: DataFrame) -> list[str]:
    """Every column of a wide snapshot that is not metadata."""
    return [c for c in wide.columns if c not in METADATA_KEYS]


def params_object(wide: DataFrame, tags: Sequence[str] | None = None) -> Column:
    """The tags of a wide snapshot as one object; each keeps its type, so a text tag stays text."""
    tags = list(tags) if tags is not None else snapshot_tags(wide)
    if not tags:
        return F.create_map().cast("map<string,double>")
    return F.struct(*[F.col("`" + t.replace("`", "``") + "`").alias(t) for t in tags])


def _meta(wide: DataFrame, name: str, default) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in wide.columns else F.lit(default)


def envelope_struct(wide: DataFrame, tags: Sequence[str] | None = None) -> Column:
    sim = _meta(wide, "sim_time", 0.0).cast("double")
    return F.struct(
        sim.alias("timestamp"),
        _meta(wide, "time_str", "").cast("string").alias("datetime"),
        _meta(wide, "cycle_count", 0).cast("int").alias("cycle_count"),
        sim.alias("sim_time"),
        params_object(wide, tags).alias("params"),
    )


def encode_envelope(wide: DataFrame, tags: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One JSON text per snapshot row (column ``value``, ready for a file or Kafka sink); a null tag is written as null."""
    return wide.select(*keep, F.to_json(envelope_struct(wide, tags), {"ignoreNullFields": "false"}).alias("value"))


def notification(wide: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``{"timestamp": sim_time, "cycle_count": n}`` per snapshot row."""
    return wide.select(
        *keep,
        F.to_json(
            F.struct(_meta(wide, "sim_time", 0.0).cast("double").alias("timestamp"), _meta(wide, "cycle_count", 0).cast("int").alias("cycle_count"))
        ).alias("value"),
    )


_DECODE_SCHEMA = T.StructType(
    [f if f.name != "params" else T.StructField("params", T.MapType(T.StringType(), T.VariantType())) for f in ENVELOPE_SCHEMA.fields]
    + [T.StructField("_corrupt", T.StringType())]
)


def decode_envelope(texts: DataFrame, value: str = "value", keep: Sequence[str] = (), numeric_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(good, rejected)``. ``good`` has one row per numeric tag of each valid envelope.

    One PERMISSIVE parse per row (behind a Generate, so that no filter repeats it): text that is not a JSON object lands in the
    corrupt-record column (``malformed``); objects without params, or with an
    empty map, are ``no_params``. A number or boolean is a numeric tag (as are
    NaN and the infinities, which JSON can only write as text); a tag of
    another type, text of digits included, is dropped (S8) without rejecting the whole envelope. With
    ``numeric_only=False`` it stays, with a null value.
    """
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = texts.select(*keep, F.col(value).alias("_raw"), F.explode(F.array(F.from_json(F.col(value), _DECODE_SCHEMA, opts))).alias("env"))
    malformed = F.col("_raw").isNull() | F.col("env").isNull() | F.col("env._corrupt").isNotNull()
    no_params = F.col("env.params").isNull() | (F.size("env.params") == 0)
    reason = F.when(malformed, F.lit("malformed")).when(no_params, F.lit("no_params"))
    tagged = parsed.withColumn("_reason", reason)
    rejected = tagged.filter(F.col("_reason").isNotNull()).select(*keep, F.col("_raw").alias(value), F.col("_reason").alias("reason"))
    good = tagged.filter(F.col("_reason").isNull()).select(
        *keep,
        F.col("env.timestamp").alias("timestamp"),
        F.col("env.datetime").alias("datetime"),
        F.col("env.cycle_count").alias("cycle_count"),
        F.col("env.sim_time").alias("sim_time"),
        F.explode("env.params").alias("param_name", "_any"),
    )
    numeric = F.schema_of_variant("_any").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)") | F.try_variant_get("_any", "$", "string").isin("NaN", "Infinity", "-Infinity")
    good = good.withColumn("param_value", F.when(numeric, F.try_variant_get("_any", "$", "double"))).drop("_any")
    good = good.filter(F.col("param_value").isNotNull()) if numeric_only else good
    good = good.withColumn("instance_name", instance_of("param_name")).withColumn("param_type", classify_instance(instance_of("param_name")))
    return good, rejected


def discovered_tags(tags: DataFrame) -> DataFrame:
    """First sighting of every tag of decoded envelopes (``numeric_only=False``); a value that is no number registers as 0.0."""
    key = F.struct("sim_time", "cycle_count")
    return tags.groupBy("param_name", "instance_name", "param_type").agg(
        F.min("sim_time").alias("first_seen"), F.min_by(F.coalesce("param_value", F.lit(0.0)), key).alias("initial_value")
    )


def decode_notification(texts: DataFrame, value: str = "value") -> DataFrame:
    return texts.select(F.from_json(F.col(value), NOTIFICATION_SCHEMA).alias("n")).select("n.timestamp", "n.cycle_count")


def decode_fields(texts: DataFrame, schema: str, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Generic PERMISSIVE decode of a JSON text column with an explicit schema (NULL fields on bad input)."""
    return texts.select(*keep, F.from_json(F.col(value), schema, {"mode": "PERMISSIVE"}).alias("j")).select(*keep, "j.*")
