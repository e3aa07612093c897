"""U2 in batch: a registered step program over every series of a table.

A step function is opaque, so the rows of one series can only be taken one after
the other. They go chunk by chunk on the layout of the series operators: wave
``k`` runs the ``k``-th chunk of every series in parallel, from the states that
wave ``k - 1`` wrote. No group holds more than a chunk, a wave reads only its own
folder, and a lost executor costs a chunk. The number of waves is the longest
series over the chunk size; where an operator of its own exists (lag, slew limit,
sampling) it solves all chunks at once and is the better choice.

A program with an associative form needs no waves. Every chunk combines its rows'
elements to one, a parallel prefix over the chunk table (blocks of ``FAN`` elements,
upwards and back down: a logarithmic number of rounds) gives each chunk the element
of all rows before it, and then all chunks step at once from the states that these
lead to.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tagloom.functions.registry import program
from tagloom.operators.series import SeriesSpec, _as_long, lay_out
from tagloom.session import materialize, scratch_path

#: elements combined in one group of the parallel prefix
FAN = 64


def run_program(
    df: DataFrame,
    spec: SeriesSpec,
    name: str,
    inputs: Mapping[str, str],
    params: Mapping[str, object] | None = None,
    output_types: Mapping[str, str] | None = None,
) -> DataFrame:
    """``df`` with the outputs of program ``name`` (double unless ``output_types`` says otherwise).

    ``inputs`` maps the program's input names to columns; the first order
    column reaches it as the integer ``us`` (microseconds of a timestamp), so it
    must be a timestamp or an integer. States are JSON between chunks. Nulls
    reach the step as None, NaN as NaN. An output named like a column replaces
    it. Runs its jobs while the plan is built; the result is a table in the
    checkpoint folder.
    """
    spark = df.sparkSession
    root = scratch_path(spark, "program")
    prog = program(name)
    settings, types = prog.params(**(params or {})), dict(output_types or {})
    by, order = list(spec.by), list(spec.order)
    keep = [c for c in df.columns if c != "_chunk" and c not in prog.outputs]
    added = [T.StructField(c, T._parse_datatype_string(types.get(c, "double"))) for c in prog.outputs]
    schema = T.StructType([*(df.schema[c] for c in keep), *added, T.StructField("_state", T.StringType())])
    time = _as_long(df, order[0])
    if time is None:
        raise ValueError(f"a step program needs a timestamp or integer order, not {df.schema[order[0]].dataType.simpleString()}")

    laid = lay_out(df, spec).withColumns({"_us": time} | {f"_in_{k}": F.col(f"`{c}`") for k, c in inputs.items()})
    arrow = [(f.name, to_arrow_type(f.dataType)) for f in added]
    ascending = [(c, "ascending") for c in order]

    def inputs_of(table: pa.Table):
        columns = {"us": table["_us"].to_pylist()} | {k: table[f"_in_{k}"].to_pylist() for k in inputs}
        return (dict(zip(columns, values)) for values in zip(*columns.values()))

    if prog.lift is not None:
        return _scan(laid, by, order, prog, settings, keep, added, inputs_of)
    ranks = laid.select(*by, "_chunk").distinct().withColumn("_wave", F.row_number().over(Window.partitionBy(*by).orderBy("_chunk")))
    laid.join(ranks, [*by, "_chunk"]).drop("_chunk").write.partitionBy("_wave").parquet(f"{root}/rows")
    waves = ranks.agg(F.max("_wave")).first()[0] or 0
    if not waves:
        return spark.createDataFrame([], T.StructType(schema.fields[:-1]))

    def steps(table: pa.Table) -> pa.Table:
        table = table.sort_by(ascending)
        stored = table["_state"][0].as_py()
        state = prog.init(settings) if stored is None else json.loads(stored)
        found = []
        for row in inputs_of(table):
            state, result = prog.step(state, row, settings)
            found.append(result)
        out = table.select(keep)
        for c, kind in arrow:
            out = out.append_column(c, pa.array([r.get(c) for r in found], kind))
        states = [None] * (len(found) - 1) + [json.dumps(state)]
        return out.append_column("_state", pa.array(states, pa.string()))

    rows = spark.read.parquet(f"{root}/rows")
    states = None
    for wave in range(1, waves + 1):
        part = rows.where(F.col("_wave") == wave).drop("_wave")
        part = part.withColumn("_state", F.lit(None).cast("string")) if states is None else part.join(states, by)
        part.groupBy(*by).applyInArrow(lambda _, t: steps(t), schema).write.parquet(f"{root}/out/wave={wave}")
        states = spark.read.schema(schema).parquet(f"{root}/out/wave={wave}").where(F.col("_state").isNotNull()).select(*by, "_state")
    return spark.read.schema(schema).parquet(*[f"{root}/out/wave={wave}" for wave in range(1, waves + 1)]).drop("_state")


def _scan(laid: DataFrame, by: list[str], order: list[str], prog, settings: Mapping[str, object], keep: list[str], added: list[T.StructField], inputs_of) -> DataFrame:
    """All chunks at once, each from the state that the elements of the chunks before it lead to."""
    ascending = [(c, "ascending") for c in order]
    keys = [laid.schema[c] for c in by]
    total_schema = T.StructType([*keys, T.StructField("_chunk", T.LongType()), T.StructField("_e", T.StringType())])
    out_schema = T.StructType([*(laid.schema[c] for c in keep), *added])

    def total(table: pa.Table) -> pa.Table:
        table = table.sort_by(ascending)
        element = reduce(prog.combine, (prog.lift(row, settings) for row in inputs_of(table)))
        head = [pa.array([table[c][0].as_py()], table.schema.field(c).type) for c in (*by, "_chunk")]
        return pa.table([*head, pa.array([json.dumps(element)])], names=total_schema.names)

    def steps(table: pa.Table) -> pa.Table:
        table = table.sort_by(ascending)
        before = table["_before"][0].as_py()
        state = prog.init(settings)
        state = state if before is None else prog.act(state, json.loads(before))
        found = []
        for row in inputs_of(table):
            state, result = prog.step(state, row, settings)
            found.append(result)
        out = table.select(keep)
        for f in added:
            out = out.append_column(f.name, pa.array([r.get(f.name) for r in found], to_arrow_type(f.dataType)))
        return out

    narrow = laid.select(*dict.fromkeys([*by, "_chunk", *order, "_us", *[c for c in laid.columns if c.startswith("_in_")]]))
    totals = materialize(narrow.groupBy(*by, "_chunk").applyInArrow(total, total_schema), "program-totals")
    before = prefixes(totals, by, prog.combine)
    return laid.join(before, [*by, "_chunk"]).groupBy(*by, "_chunk").applyInArrow(steps, out_schema)


def prefixes(totals: DataFrame, by: list[str], combine) -> DataFrame:
    """``by, _chunk`` and ``_before``: the element of all chunks of the series before it (null for the first).

    Blocks of ``FAN`` elements combine upwards until one block covers a series, and
    their prefixes go back down: two rounds a level, ``log(chunks)`` levels to base ``FAN``.
    """
    places = totals.withColumn("_place", (F.row_number().over(Window.partitionBy(*by).orderBy("_chunk")) - 1).cast("long"))
    places = materialize(places, "program-places")
    keys = [totals.schema[c] for c in by]
    block_schema = T.StructType([*keys, T.StructField("_place", T.LongType()), T.StructField("_e", T.StringType())])
    before_schema = T.StructType([*keys, T.StructField("_place", T.LongType()), T.StructField("_before", T.StringType())])
    fan = FAN  # workers get the value of the session

    def block(table: pa.Table) -> pa.Table:
        table = table.sort_by("_place")
        element = reduce(combine, map(json.loads, table["_e"].to_pylist()))
        head = [pa.array([table[c][0].as_py()], table.schema.field(c).type) for c in by]
        return pa.table([*head, pa.array([table["_place"][0].as_py() // fan]), pa.array([json.dumps(element)])], names=block_schema.names)

    def children(table: pa.Table) -> pa.Table:
        table = table.sort_by("_place")
        so_far, out = table["_before"][0].as_py(), []
        so_far = None if so_far is None else json.loads(so_far)
        for element in map(json.loads, table["_e"].to_pylist()):
            out.append(None if so_far is None else json.dumps(so_far))
            so_far = element if so_far is None else combine(so_far, element)
        return pa.table([*[table[c] for c in by], table["_place"], pa.array(out, pa.string())], names=before_schema.names)

    levels, most = [places.select(*block_schema.names)], (places.agg(F.max("_place")).first()[0] or 0) + 1
    while most > fan:
        most = -(-most // fan)
        blocks = levels[-1].groupBy(*by, F.floor(F.col("_place") / fan).cast("long").alias("_block")).applyInArrow(lambda _, t: block(t), block_schema)
        levels.append(materialize(blocks, "program-block"))
    before = None
    for level in reversed(levels):
        rows = level.withColumn("_block", F.floor(F.col("_place") / fan).cast("long"))
        if before is None:
            rows = rows.withColumn("_before", F.lit(None).cast("string"))
        else:
            rows = rows.join(before.withColumnRenamed("_place", "_block"), [*by, "_block"])
        before = materialize(rows.groupBy(*by, "_block").applyInArrow(lambda _, t: children(t), before_schema), "program-before")
    return places.select(*by, "_chunk", "_place").join(before, [*by, "_place"]).drop("_place")
