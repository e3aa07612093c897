"""T5: a registered step program per series on a stream, by ``transformWithStateInPandas``.

Rows arrive in any order. The tasks that read them pack them: one sorted block of rows
(an Arrow table) a key and batch. The blocks of a key are gathered into sorted *runs*
of at most ``BUFFER_ROWS`` rows, which wait in the state store as blocks of
``BLOCK_ROWS``; many runs are merged into one. An event-time timer stands at the end of
the earliest waiting time slot of the key. When the watermark has passed it, the runs
are merged, block by block, as far as the slots that the watermark has passed, so each
key's rows are applied in order across micro-batches. Calls to the store are counted
by blocks, not rows, and what a task holds is a buffer, or one block of each of at most
``RUNS`` runs with the rows of one time: neither follows the number of rows of a key.
The store is RocksDB, which keeps state on disk.

A row older than one already applied to its key comes out at once, flagged ``late``.
Spark would drop rows behind the watermark before they are seen; the event-time
column is therefore left out behind the watermark, which keeps the timers and
leaves lateness to this rule.

The last rows of a stream wait for a watermark that no later row brings. A finite
run is closed by one row of a side stream with the greatest time
(:func:`with_closing`, :func:`close`).
"""

from __future__ import annotations

import contextlib
import datetime as _dt
import json
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor

from tagloom.functions.registry import Program, program
from tagloom.streaming import programs as _builtin  # noqa: F401  (registers VALVE, LAG, SAMPLER)

#: milliseconds of event time that are sorted and applied together
SLOT_MS = 1000
#: rows, or bytes, of a key's micro-batch that are sorted into one run
BUFFER_ROWS, BUFFER_BYTES = 1 << 16, 1 << 26
#: rows, or bytes, of a stored block
BLOCK_ROWS, BLOCK_BYTES = 1 << 10, 1 << 20
#: runs of one size that are merged into one
RUNS = 64
_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 25),  # packed rows are large
}
_END = _dt.datetime(9999, 12, 31)
_CLOSING = "_tl_closing"
_KEY, _AT, _TIE, _IN, _KEPT = "_tl_key", "at", "t", "i", "k"


def _to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _from_bytes(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _sorted(table: pa.Table, ties: int) -> pa.Table:
    """By (time, tie-breakers), nulls first."""
    order = [(_AT, "ascending")] + [(f"{_TIE}{i}", "ascending") for i in range(ties)]
    # a stable order: rows alike in time and tie-breakers stay as they came
    table = table.append_column("_n", pa.array(range(table.num_rows), pa.int64()))
    return table.take(pc.sort_indices(table, [*order, ("_n", "ascending")], null_placement="at_start")).drop_columns(["_n"])


def _key_text(values: Sequence[object]) -> str:
    """Text of a key, the same for equal keys only (0.0 and -0.0 are equal)."""
    return repr([0.0 if type(v) is float and v == 0 else v for v in values])


def _pack(names: Sequence[str], by: int, ties: int):
    """Batches of rows (key columns first) as (key text, sorted rows), one a key and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]).rename_columns(list(names))
            keys = {}
            for i, values in enumerate(zip(*[table.column(c).to_pylist() for c in names[:by]])):
                keys.setdefault(_key_text(values), []).append(i)
            packed = [_to_bytes(_sorted(table.take(pa.array(at, pa.int64())), ties).combine_chunks()) for at in keys.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(keys), pa.string()), pa.array(packed, pa.binary())], [_KEY, "rows"])

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0):
            yield from _from_bytes(data.as_py()).combine_chunks().to_batches()


class Runs:
    """The sorted runs of one key in a map state: blocks by (run, number), and at number -1 the time that each block starts with.

    ``open`` lists [run, level, first block] of the runs that hold rows.
    """

    def __init__(self, blocks, opened: list[list[int]], ties: int):
        self.blocks, self.open, self.ties = blocks, opened, ties

    def _new(self, tables: Iterator[pa.Table], level: int) -> None:
        run, firsts = 1 + max((r[0] for r in self.open), default=-1), []
        for table in tables:
            size = max(1, min(BLOCK_ROWS, BLOCK_BYTES * table.num_rows // max(1, table.nbytes)))
            for at in range(0, table.num_rows, size):
                block = table.slice(at, size)
                self.blocks.updateValue((run, len(firsts)), (_to_bytes(block),))
                firsts.append(block.column(_AT)[0].as_py())
        self.blocks.updateValue((run, -1), (json.dumps(firsts).encode(),))
        self.open.append([run, level, 0])

    def add(self, table: pa.Table) -> None:
        """Store a sorted table as a run; ``RUNS`` runs of one level become one of the next."""
        self._new(iter([table]), 0)
        level = 0
        while len(same := [r for r in self.open if r[1] == level]) >= RUNS:
            self._new(self.take(None, same), level + 1)
            level += 1

    def first(self) -> int | None:
        """The earliest time."""
        return min((json.loads(self.blocks.getValue((run, -1))[0])[block] for run, _, block in self.open), default=None)

    def take(self, until: int | None, runs: list[list[int]] | None = None) -> Iterator[pa.Table]:
        """Rows with times before ``until`` (None: all) in order, in tables of whole times; they leave the state."""
        runs = self.open if runs is None else runs
        firsts = {r[0]: json.loads(self.blocks.getValue((r[0], -1))[0]) for r in runs}
        held: dict[int, pa.Table] = {}
        after = {r[0]: r[2] for r in runs}  # next block to read

        def read(run: int) -> None:
            n = after[run]
            table = _from_bytes(self.blocks.getValue((run, n))[0])
            held[run] = pa.concat_tables([held[run], table]) if run in held else table
            after[run] = n + 1

        while True:
            # the earliest unread block bounds what is complete; blocks that start there are read
            unread = {r: f[after[r]] for r, f in firsts.items() if after[r] < len(f)}
            low = min([t.column(_AT)[0].as_py() for t in held.values()], default=None)
            bound = min(unread.values(), default=None)
            if bound is not None and (low is None or bound <= low):
                if until is not None and bound >= until and low is None:
                    break
                for run, at in unread.items():
                    if at == bound:
                        read(run)
                continue
            if low is None or (until is not None and low >= until):
                break
            cut = bound if until is None else until if bound is None else min(bound, until)
            parts = []
            for run, table in list(held.items()):
                n = table.num_rows if cut is None else pc.sum(pc.less(table.column(_AT), cut)).as_py() or 0
                parts.append(table.slice(0, n))
                if n == table.num_rows:
                    del held[run]
                elif n:
                    held[run] = table.slice(n)
            yield _sorted(pa.concat_tables(parts), self.ties)
        for r in list(runs):
            run, read_to = r[0], after[r[0]]
            if run in held:  # blocks that were begun stay as one block
                kept = read_to - 1
                self.blocks.updateValue((run, kept), (_to_bytes(held[run].combine_chunks()),))
                firsts[run][kept] = held[run].column(_AT)[0].as_py()
                self.blocks.updateValue((run, -1), (json.dumps(firsts[run]).encode(),))
            else:
                kept = read_to
            for n in range(r[2], kept):
                self.blocks.removeKey((run, n))
            r[2] = kept
            if kept == len(firsts[run]):
                self.blocks.removeKey((run, -1))
                self.open.remove(r)


class KeyedProgram(StatefulProcessor):
    """Waiting rows as sorted runs, and the program's state with the time of the last row applied."""

    def __init__(self, prog: Program, params: Mapping[str, object], by: int, inputs: Sequence[str], ties: int, kept: int, schema: T.StructType, slot_ms: int):
        self.prog, self.params, self.slot_ms = prog, dict(params), slot_ms
        self.by, self.inputs, self.ties, self.kept, self.schema = by, list(inputs), ties, kept, schema

    def init(self, handle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "run long, number long", "rows binary")
        # the runs that hold rows, and their timer
        self.runs = handle.getValueState("runs", "open string, timer long")
        self.applied = handle.getValueState("applied", "state string, last long")

    def close(self) -> None:
        pass

    def _out(self, table: pa.Table, results: Mapping[str, list] | None) -> pd.DataFrame:
        n, names = table.num_rows, self.schema.names
        columns = [table.column(i) for i in range(self.by)] + [table.column(f"{_KEPT}{i}") for i in range(self.kept)]
        for c in self.prog.outputs:
            kind = to_arrow_type(self.schema[c].dataType)
            columns.append(pa.nulls(n, kind) if results is None else pa.array(results[c], kind))
        columns.append(pa.array([results is None] * n, pa.bool_()))
        return pd.DataFrame({"rows": [_to_bytes(pa.table(columns, names=names))]})

    def _load(self) -> tuple[Runs, int | None]:
        opened, timer = self.runs.get() if self.runs.exists() else ("[]", None)
        return Runs(self.blocks, json.loads(opened), self.ties), timer

    def _save(self, runs: Runs, timer: int | None, expired: int | None = None) -> None:
        """Keep the runs and set the timer at the end of the earliest slot; the expired one is dropped by Spark."""
        first = runs.first()
        due = None if first is None else (first // 1000 // self.slot_ms + 1) * self.slot_ms
        if due != timer:
            if timer is not None and timer != expired:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.runs.update((json.dumps(runs.open), due))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.applied.get()[1] if self.applied.exists() else None
        runs, timer = self._load()
        buffer: list[pa.Table] = []

        def flush() -> None:
            if buffer:
                runs.add(_sorted(pa.concat_tables(buffer), self.ties))
                buffer.clear()

        for data in (x for frame in rows for x in frame["rows"]):
            table = _from_bytes(data)
            at = table.column(_AT)
            late = pc.is_null(at) if last is None else pc.or_(pc.is_null(at), pc.fill_null(pc.less(at, last), True))
            if pc.any(late).as_py():
                yield self._out(table.filter(late), None)
                table = table.filter(pc.invert(late))
            if table.num_rows:
                buffer.append(table)
            if sum(t.num_rows for t in buffer) >= BUFFER_ROWS or sum(t.nbytes for t in buffer) >= BUFFER_BYTES:
                flush()
        flush()
        if runs.open:
            self._save(runs, timer)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        runs, timer = self._load()
        if timer != (fired := expiredTimerInfo.getExpiryTimeInMs()):
            return  # another one stands for the rows
        state = json.loads(self.applied.get()[0]) if self.applied.exists() else self.prog.init(self.params)
        # timers before the watermark expire, and with them the slots that end before it
        passed = max(fired, timerValues.getCurrentWatermarkInMs() - 1) // self.slot_ms * self.slot_ms
        last = None
        for table in runs.take(passed * 1000):
            results: dict[str, list] = {c: [] for c in self.prog.outputs}
            at = table.column(_AT).to_pylist()
            values = [table.column(f"{_IN}{i}").to_pylist() for i in range(len(self.inputs))]
            for us, *row in zip(at, *values):
                state, found = self.prog.step(state, {"us": us} | dict(zip(self.inputs, row)), self.params)
                for c, to in results.items():
                    to.append(found.get(c))
            last = at[-1]
            yield self._out(table, results)
        if last is not None:
            self.applied.update((json.dumps(state), last))
        self._save(runs, timer, fired)


def keyed_state(
    df: DataFrame,
    program_name: str,
    by: Sequence[str],
    order_col: str,
    inputs: Mapping[str, str],
    params: Mapping[str, object] | None = None,
    passthrough: Sequence[str] = (),
    output_types: Mapping[str, str] | None = None,
    tie_break: Sequence[str] = (),
    delay: str = "0 seconds",
    slot_ms: int = SLOT_MS,
) -> DataFrame:
    """T5: run a registered program per series key on a stream (streaming frames only).

    ``order_col`` is a BIGINT event time in microseconds. ``inputs`` maps program
    input names to columns. Output: key, passthrough columns, the program's
    outputs, and ``late``: a row older than one already applied to its key, or
    without a time, is kept with ``late`` true and null outputs. Rows wait until the
    watermark, ``delay`` behind the greatest time, has passed their slot of
    ``slot_ms``; equal times are applied in the order of ``tie_break``. Nulls reach
    the step as None, NaN as NaN. Start the query inside :func:`rocksdb`.
    """
    prog = program(program_name)
    types = dict(output_types or {})
    kept = [c for c in passthrough if c not in by]
    fields = [df.schema[c] for c in (*by, *kept)]
    fields += [T.StructField(name, T._parse_datatype_string(types.get(name, "double"))) for name in prog.outputs]
    schema = T.StructType([*fields, T.StructField("late", T.BooleanType())])
    marked = df.withColumn("_tl_at", F.timestamp_micros(order_col)).withWatermark("_tl_at", delay)
    if _CLOSING in df.columns:
        # by the time column: a filter on any other would be pushed below the watermark
        marked = marked.where(F.col("_tl_at").isNull() | (F.col("_tl_at") < F.lit(_END).cast("timestamp")))
    cols = {f"b{i}": c for i, c in enumerate(by)} | {_AT: order_col}
    cols |= {f"{_TIE}{i}": c for i, c in enumerate(tie_break)} | {f"{_IN}{i}": c for i, c in enumerate(inputs.values())} | {f"{_KEPT}{i}": c for i, c in enumerate(kept)}
    step = KeyedProgram(prog, prog.params(**(params or {})), len(by), list(inputs), len(tie_break), len(kept), schema, slot_ms)
    packed = marked.select(*[F.col(c).alias(name) for name, c in cols.items()]).mapInArrow(_pack(list(cols), len(by), len(tie_break)), f"{_KEY} string, rows binary")
    return packed.groupBy(_KEY).transformWithStateInPandas(step, "rows binary", "append", "EventTime").mapInArrow(_unpack, schema)


@contextlib.contextmanager
def rocksdb(spark: SparkSession, partitions: int | None = None):
    """State of queries that start inside goes to RocksDB, as ``transformWithState`` needs, in batches of bounded bytes.

    ``partitions`` of the state (of the session's shuffles, if not given) are fixed
    by a query's first start; one for each core is enough.
    """
    wanted = _CONF | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def with_closing(stream: DataFrame, order_col: str, folder: str) -> DataFrame:
    """``stream`` and the closing row that :func:`close` writes to ``folder``, which is created here."""
    spark = stream.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    end = spark.readStream.schema(f"`{order_col}` long").parquet(folder).withColumn(_CLOSING, F.lit(True))
    return stream.withColumn(_CLOSING, F.lit(False)).unionByName(end, allowMissingColumns=True)


def close(spark: SparkSession, order_col: str, folder: str) -> None:
    """Write the row that moves the watermark past every time; run the query once more after it."""
    end = int((_END - _dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    spark.createDataFrame([(end,)], f"`{order_col}` long").coalesce(1).write.mode("append").parquet(folder)
