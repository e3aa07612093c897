"""Greedy interval sampling and cycle-stride sampling.

Greedy rule (sequential by definition): over the distinct timestamps of the
filtered rows, ascending, keep the first; keep ``t`` iff ``t - last_kept >=
interval``. The anchor drifts, so it is not a tumbling window.

Distributed plan
----------------
Let ``s(t)`` be the first timestamp ``>= t + I``; the kept set is the chain
``t0, s(t0), s(s(t0)), ...``. What a part of the time axis does to the chain is a
step function: the *threshold* with which the chain comes in (last kept + I) goes to
the threshold with which it leaves.

1. Literal split points cut the distinct timestamps (partial aggregation first)
   into parts of about ``CHUNK_ROWS``, or as many as shuffle partitions.
2. One pass sorts each part (numpy) and writes a row a part: its timestamps, and
   the step function, by pointer doubling inside the part. The chain can only enter
   at an element below ``min + I`` or the next one, so only these are its steps.
3. Up to ``FAN`` consecutive parts' functions compose in one group to that of a
   block, until one block is left, and thresholds go back down: a logarithmic number
   of rounds over one row a part, none of them if there are no more than ``FAN``.
4. A second pass walks each part's chain from its threshold. Rows at kept
   timestamps come back with a semi-join.

Nothing of size proportional to the data reaches the driver or one task; a group
holds the steps of ``FAN`` parts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators.query import history_filter, query_history
from tagloom.operators.splits import split_points
from tagloom.schema import HISTORY_COLUMNS
from tagloom.session import materialize

#: step functions composed in one group
FAN = 16

MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})"


def micros(col: str = "timestamp") -> Column:
    return F.expr(MICROS.format(c=f"`{col}`"))


def from_micros(col: str = "us") -> Column:
    return F.expr(f"timestampadd(MICROSECOND, `{col}`, TIMESTAMP_NTZ'1970-01-01 00:00:00')")


def interval_micros(seconds: float) -> int:
    """Interval in whole microseconds (``diff >= I`` on integers)."""
    return max(1, int(math.ceil(seconds * 1e6 - 1e-6)))


def _exit_of(a: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """successor index array ``s`` and, per element, the last chain element inside the array."""
    n = len(a)
    s = np.searchsorted(a, a + step, side="left")
    f = np.where(s < n, s, np.arange(n))
    g = f
    for _ in range(max(1, int(math.ceil(math.log2(n + 1)))) + 1):
        g = g[g]
    return s, g


_STEPS = "part long, top long, cand array<long>, exit array<long>"


def _steps_of(a: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Elements that the chain may enter the sorted ``a`` by, and the threshold that it leaves with from each."""
    _, end = _exit_of(a, step)
    m = min(int(np.searchsorted(a, a[0] + step, side="left")), len(a) - 1)
    return a[: m + 1], a[end[: m + 1]] + step


def _through(thresholds: np.ndarray, top: int, cand: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """Thresholds behind a part; those beyond its last element ``top`` pass."""
    at = np.searchsorted(cand, thresholds, side="left")
    return np.where(thresholds <= top, leave[np.minimum(at, len(leave) - 1)], thresholds)


def _parts(table: pa.Table) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    table = table.sort_by("part")
    return [(table["part"][i].as_py(), table["top"][i].as_py(), table["cand"][i].values.to_numpy(), table["exit"][i].values.to_numpy()) for i in range(len(table))]


def _lists(values: list[np.ndarray]) -> pa.Array:
    return pa.array(values, pa.list_(pa.int64()))


def _thresholds(steps: DataFrame, parts: int, step: int) -> dict[int, int]:
    """The chain's threshold before every part, composed over blocks of ``FAN`` parts and walked back down."""
    names = ["part", "top", "cand", "exit"]

    def block(key: tuple, table: pa.Table) -> pa.Table:
        found = _parts(table)
        inside = np.concatenate([cand for _, _, cand, _ in found])
        first = found[0][2][0]
        keep = inside[: int(np.searchsorted(inside, first + step, side="left")) + 1]
        leave = keep
        for _, top, cand, exits in found:
            leave = _through(leave, top, cand, exits)
        return pa.table([pa.array([key[0].as_py()]), pa.array([found[-1][1]]), _lists([keep]), _lists([leave])], names=names)

    def walk(before: dict[int, int]):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            found, out = _parts(table), []
            at = np.array([before.get(key[0].as_py(), np.iinfo(np.int64).min)])
            for _, top, cand, exits in found:
                out.append(int(at[0]))
                at = _through(at, top, cand, exits)
            return pa.table([pa.array([p for p, *_ in found]), pa.array(out, pa.int64())], names=["part", "at"])

        return run

    levels, fan = [steps], FAN
    while parts > fan:
        parts = -(-parts // fan)
        levels.append(materialize(levels[-1].groupBy(F.floor(F.col("part") / fan).cast("long").alias("block")).applyInArrow(block, _STEPS), "sampling-block"))
    before: dict[int, int] = {}
    for level in reversed(levels):
        walked = level.groupBy(F.floor(F.col("part") / fan).cast("long").alias("block")).applyInArrow(walk(before), "part long, at long")
        before = {r["part"]: r["at"] for r in walked.collect()}  # one number a part
    return before


def greedy_kept_micros(rows: DataFrame, interval_seconds: float, ts_col: str = "timestamp", num_partitions: int | None = None) -> DataFrame:
    """Kept timestamps (``us`` BIGINT, epoch microseconds) of the greedy interval rule over ``rows``; runs jobs while the plan is built."""
    step = interval_micros(interval_seconds)
    times = rows.select(micros(ts_col).alias("us")).where("us IS NOT NULL")
    points = split_points(times, ["us"], num_partitions)
    distinct = times.distinct().withColumn("part", points.index())

    def to_steps(key: tuple, table: pa.Table) -> pa.Table:
        a = np.sort(table["us"].to_numpy())
        cand, leave = _steps_of(a, step)
        return pa.table([pa.array([key[0].as_py()]), pa.array([a[-1]]), _lists([cand]), _lists([leave]), _lists([a])], names=["part", "top", "cand", "exit", "us"])

    parts = materialize(distinct.groupBy("part").applyInArrow(to_steps, _STEPS + ", us array<long>"), "sampling-parts")
    before = _thresholds(parts.select("part", "top", "cand", "exit"), points.parts, step)

    def emit(batches):
        for batch in batches:
            for part, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                a = values.values.to_numpy()
                jump = np.searchsorted(a, a + step, side="left").tolist()
                i, kept = int(np.searchsorted(a, before[part], side="left")), []
                while i < len(a):
                    kept.append(i)
                    i = jump[i]
                yield pa.RecordBatch.from_arrays([pa.array(a[np.asarray(kept, dtype=np.int64)])], ["us"])

    return parts.select("part", "us").mapInArrow(emit, "us long")


def greedy_kept_timestamps(rows: DataFrame, interval_seconds: float, ts_col: str = "timestamp") -> DataFrame:
    """A4 + P1: kept timestamps as a ``timestamp`` column."""
    return greedy_kept_micros(rows, interval_seconds, ts_col).select(from_micros("us").alias("timestamp"))


def query_sampled(
    history: DataFrame,
    param_name: str | None = None,
    instance_name: str | None = None,
    start_time=None,
    end_time=None,
    sample_interval: float | None = None,
    limit: int | None = 1000,
) -> DataFrame:
    """Greedy-sampled history rows, newest first; ``limit`` counts rows.

    ``sample_interval`` None or <= 0 falls back to the plain history query (P2).
    """
    if sample_interval is None or sample_interval <= 0:
        return query_history(history, param_name, instance_name, start_time, end_time, limit=limit)
    rows = history_filter(history, param_name, instance_name, start_time, end_time)
    kept = greedy_kept_micros(rows, sample_interval)
    joined = rows.withColumn("_us", micros("timestamp")).join(kept.withColumnRenamed("us", "_us"), "_us", "left_semi")
    out = joined.select(*HISTORY_COLUMNS).orderBy(F.desc("timestamp"), F.desc("id"))
    return out.limit(limit) if limit is not None else out


def sample_flag(cycle: str | Column, cycle_time: float, sample_interval: float | None) -> Column:
    """``cycle % k == 0`` with ``k = max(1, int(sample_interval / cycle_time))`` (None: every cycle)."""
    if cycle_time <= 0:
        raise ValueError(f"a cycle must last longer than zero seconds: {cycle_time}")
    if sample_interval is not None and sample_interval <= 0:
        raise ValueError(f"no sampling every {sample_interval} seconds")
    if sample_interval is not None and sample_interval < cycle_time:
        raise ValueError(f"sampling every {sample_interval} s is finer than the cycle of {cycle_time} s")
    k = 1 if sample_interval is None else max(1, int(sample_interval / cycle_time))
    c = F.col(cycle) if isinstance(cycle, str) else cycle
    return (c % F.lit(k)) == 0


def stride_sample(wide: DataFrame, cycle: str, cycle_time: float, sample_interval: float | None) -> DataFrame:
    """Keep the rows of sampled cycles of a wide table."""
    return wide.filter(sample_flag(cycle, cycle_time, sample_interval))
