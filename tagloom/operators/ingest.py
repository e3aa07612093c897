"""Wide snapshot -> long history ingest (tag split, classification, ids).

Everything here is a narrow projection (``unpivot`` is an Expand node, no
shuffle) except :func:`assign_ids`, which numbers the rows within ranges of the
order, so that ids stay exact and balanced however skewed the tags are.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.operators.splits import split_points
from tagloom.schema import ALGORITHM_MARKERS, HISTORY_COLUMNS, METADATA_KEYS, MODEL_MARKERS, UNKNOWN_INSTANCE

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)


def instance_of(tag: Column | str) -> Column:
    """Instance part of a tag: text before the first dot, ``unknown`` without a dot."""
    tag = F.col(tag) if isinstance(tag, str) else tag
    pos = F.instr(tag, ".")
    return F.when(pos > 0, F.substring_index(tag, ".", 1)).otherwise(F.lit(UNKNOWN_INSTANCE))


def attribute_of(tag: Column | str) -> Column:
    """Attribute part of a tag: text after the first dot, the whole tag without one."""
    tag = F.col(tag) if isinstance(tag, str) else tag
    pos = F.instr(tag, ".")
    return F.when(pos > 0, F.substr(tag, pos + 1)).otherwise(tag)


def classify_instance(instance: Column | str) -> Column:
    """``algorithm`` / ``model`` / ``variable`` by substring of the lower-cased instance."""
    inst = F.lower(F.col(instance) if isinstance(instance, str) else instance)

    def any_of(markers: Iterable[str]) -> Column:
        cond = F.lit(False)
        for m in markers:
            cond = cond | inst.contains(m)
        return cond

    return (
        F.when(any_of(ALGORITHM_MARKERS), F.lit("algorithm"))
        .when(any_of(MODEL_MARKERS), F.lit("model"))
        .otherwise(F.lit("variable"))
    )


def tag_columns(wide: DataFrame, stored_variables: Sequence[str] | None = None, extra_ids: Sequence[str] = ()) -> list[str]:
    """Tag columns of a wide snapshot: all minus metadata/id columns, numeric or boolean only.

    ``stored_variables`` is the allow-list (None = all). Non-numeric tags are
    dropped, not nulled, exactly like the history writer does.
    """
    skip = set(METADATA_KEYS) | set(extra_ids)
    allow = None if stored_variables is None else set(stored_variables)
    out = []
    for f in wide.schema.fields:
        if f.name in skip:
            continue
        if allow is not None and f.name not in allow:
            continue
        if isinstance(f.dataType, _NUMERIC):
            out.append(f.name)
    return out


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def snapshots_to_history(
    wide: DataFrame,
    timestamp: str | Column = "timestamp",
    stored_variables: Sequence[str] | None = None,
    sample_gate: bool = True,
    id_columns: Sequence[str] = (),
) -> DataFrame:
    """Unpivot a wide snapshot table into long history rows (without ``id``).

    * rows are kept only when ``need_sample`` is true (a missing column or a
      NULL flag counts as false) unless ``sample_gate`` is False;
    * metadata keys are never tags; ``id_columns`` are extra non-tag keys that
      are carried through (e.g. source keys used for ordering ids later);
    * each numeric/boolean tag becomes one row with the value cast to double;
    * instance and type derive from the tag name.
    """
    df = wide
    if sample_gate:
        if "need_sample" in df.columns:
            df = df.filter(F.coalesce(F.col("need_sample").cast("boolean"), F.lit(False)))
        else:
            df = df.filter(F.lit(False))
    tags = tag_columns(df, stored_variables, extra_ids=list(id_columns) + ([timestamp] if isinstance(timestamp, str) else []))
    ts_col = F.col(timestamp) if isinstance(timestamp, str) else timestamp
    cycle = F.col("cycle_count").cast("int") if "cycle_count" in df.columns else F.lit(0)
    sim = F.col("sim_time").cast("double") if "sim_time" in df.columns else F.lit(0.0)
    base = df.select(
        ts_col.alias("timestamp"),
        cycle.alias("cycle_count"),
        sim.alias("sim_time"),
        *[F.col(c) for c in id_columns],
        *[_q(t).cast("double").alias(t) for t in tags],
    )
    if not tags:
        raise ValueError("snapshot has no numeric tag columns")
    ids = ["timestamp", "cycle_count", "sim_time", *id_columns]
    # unpivot needs plain identifiers; dotted tag names go through a positional
    # rename and the real names come back from a literal array lookup.
    renamed = base.select(*ids, *[_q(t).alias(f"_t{i}") for i, t in enumerate(tags)])
    long = renamed.unpivot(ids, [f"_t{i}" for i in range(len(tags))], "_slot", "param_value")
    # instance and type are functions of the tag name: derive them once per tag
    # (a literal array lookup per row) instead of string work on every row.
    names, insts, kinds = _tag_tables(base.sparkSession, tags)
    slot = F.substr(F.col("_slot"), F.lit(3)).cast("int") + 1
    long = long.filter(F.col("param_value").isNotNull())
    return long.select(
        "timestamp",
        F.element_at(names, slot).alias("param_name"),
        "param_value",
        F.element_at(insts, slot).alias("instance_name"),
        F.element_at(kinds, slot).alias("param_type"),
        "cycle_count",
        "sim_time",
        *id_columns,
    )


def tag_instance(tag: str) -> str:
    """Driver-side twin of :func:`instance_of` for literal tag names."""
    return tag.split(".", 1)[0] if "." in tag else UNKNOWN_INSTANCE


def tag_type(instance: str) -> str:
    """Driver-side twin of :func:`classify_instance` for literal instance names."""
    low = instance.lower()
    if any(m in low for m in ALGORITHM_MARKERS):
        return "algorithm"
    if any(m in low for m in MODEL_MARKERS):
        return "model"
    return "variable"


def _tag_tables(spark, tags: Sequence[str]) -> tuple[Column, Column, Column]:
    """Literal arrays of tag name, instance and type for the unpivot slots."""

    def lit_arr(vals):
        return F.array(*[F.lit(v) for v in vals])

    insts = [tag_instance(t) for t in tags]
    return lit_arr(tags), lit_arr(insts), lit_arr([tag_type(i) for i in insts])


def map_snapshots_to_history(df: DataFrame, params: str = "params", timestamp: str | Column = "timestamp") -> DataFrame:
    """Map form of ingest: ``params MAP<STRING, ?>`` exploded, values ``try_cast`` to double, bad ones dropped."""
    ts_col = F.col(timestamp) if isinstance(timestamp, str) else timestamp
    cycle = F.col("cycle_count").cast("int") if "cycle_count" in df.columns else F.lit(0)
    sim = F.col("sim_time").cast("double") if "sim_time" in df.columns else F.lit(0.0)
    exploded = df.select(ts_col.alias("timestamp"), cycle.alias("cycle_count"), sim.alias("sim_time"), F.explode(params).alias("param_name", "_raw"))
    out = exploded.withColumn("param_value", F.expr("try_cast(_raw as double)")).filter(F.col("param_value").isNotNull())
    out = out.filter(~F.col("param_name").isin(list(METADATA_KEYS)))
    return out.select(
        "timestamp",
        "param_name",
        "param_value",
        instance_of("param_name").alias("instance_name"),
        classify_instance(instance_of("param_name")).alias("param_type"),
        "cycle_count",
        "sim_time",
    )


def max_id(history: DataFrame | None) -> Column | int:
    """A5: ``COALESCE(MAX(id), 0)`` of an existing history table (0 when absent)."""
    if history is None:
        return 0
    return history.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]


def assign_ids(df: DataFrame, order: Sequence[str], start: int = 1, num_partitions: int | None = None, id_col: str = "id") -> DataFrame:
    """Dense sequential ids ``start, start+1, ...`` in ``order`` (ascending, nulls first).

    Literal split points cut the order into ranges of about ``CHUNK_ROWS`` rows,
    balanced even when one tag or one instant dominates. One aggregate counts the
    ranges; the counts become the ranges' first ids, a literal array; a row's id is
    that plus its place in its range. Only the counts leave the executors and
    nothing is written: the bounds are constants, so the counting and the numbering
    pass see the same ranges. The order must be unique but for equal rows, and
    ``df`` must give the same rows whenever it is computed.
    """
    points = split_points(df, list(order), num_partitions)
    ranged = df.withColumn("_range", points.index())
    counts = {r["_range"]: r["n"] for r in ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    firsts, running = [], start - 1
    for i in range(points.parts):
        firsts.append(running)
        running += counts.get(i, 0)
    # text, as an array literal of its own for every bound would be slow to build
    before = F.split(F.lit(",".join(map(str, firsts))), ",").cast("array<long>")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*[F.col(f"`{c}`") for c in order]))
    return ranged.withColumn(id_col, (place + F.get(before, F.col("_range").cast("int"))).cast("long")).drop("_range")


def to_history(df: DataFrame, order: Sequence[str] = ("timestamp", "param_name"), start: int = 1) -> DataFrame:
    """Long rows (from :func:`snapshots_to_history`) -> full 8-column history with ids."""
    with_ids = assign_ids(df, order, start=start)
    return with_ids.select(*HISTORY_COLUMNS)
