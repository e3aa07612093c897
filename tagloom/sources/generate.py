"""Waveform datasets as closed-form columns over a cycle index.

The reference steps a counter once per cycle; every wave here is a pure
function of the 0-based index ``i`` (``cycle_count = i + 1``), so a dataset of
any length is a narrow projection over ``spark.range`` (or over any integer
column Spark derives from a table) and runs inside whole-stage codegen.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators.clock import sim_time as _sim_time
from tagloom.operators.clock import time_text
from tagloom.operators.sampling import sample_flag
from tagloom.schema import DEFAULT_CYCLE_TIME

# Waveform defaults (amplitude, period in seconds, phase).
WAVE_DEFAULTS = {"amplitude": 100.0, "period": 1200.0, "phase": 0.0}
LIST_WAVE_DEFAULT = ((0.0, 1.0),)


def _idx(i: str | Column) -> Column:
    return (F.col(i) if isinstance(i, str) else i).cast("double")


def _position(i: str | Column, period: float, cycle_time: float) -> Column:
    """(i mod P) / P with P = period / cycle_time cycles (float)."""
    p = period / cycle_time
    return F.pmod(_idx(i), F.lit(p)) / F.lit(p)


def sine(i: str | Column, amplitude: float = 100.0, period: float = 1200.0, phase: float = 0.0, cycle_time: float = DEFAULT_CYCLE_TIME) -> Column:
    """``A sin(2 pi (i mod P)/P + phase)``; phase in radians."""
    return F.lit(amplitude) * F.sin(F.lit(2 * math.pi) * _position(i, period, cycle_time) + F.lit(phase))


def _phase_pos(i, period, phase, cycle_time) -> Column:
    return F.pmod(_position(i, period, cycle_time) + F.lit(phase), F.lit(1.0))


def square(i: str | Column, amplitude: float = 100.0, period: float = 1200.0, phase: float = 0.0, cycle_time: float = DEFAULT_CYCLE_TIME) -> Column:
    """+A in the first half of the period, -A in the second; phase is a fraction of the period."""
    pos = _phase_pos(i, period, phase, cycle_time)
    return F.when(pos < 0.5, F.lit(amplitude)).otherwise(F.lit(-amplitude))


def triangle(i: str | Column, amplitude: float = 100.0, period: float = 1200.0, phase: float = 0.0, cycle_time: float = DEFAULT_CYCLE_TIME) -> Column:
    """Rises -A -> A over the first half, falls A -> -A over the second; phase is a fraction."""
    pos = _phase_pos(i, period, phase, cycle_time)
    a = F.lit(amplitude)
    return F.when(pos < 0.5, -a + F.lit(4 * amplitude) * pos).otherwise(a - F.lit(4 * amplitude) * (pos - F.lit(0.5)))


def list_segments(wave_list: Sequence[Sequence[float]], cycle_time: float = DEFAULT_CYCLE_TIME) -> list[tuple[float, int]]:
    """Validate ``[(value, seconds), ...]`` and convert to ``(value, cycles)`` (at least one cycle each)."""
    if not isinstance(wave_list, (list, tuple)) or len(wave_list) == 0:
        raise ValueError("wave_list must be a non-empty list of (value, seconds)")
    out = []
    for item in wave_list:
        if not isinstance(item, (list, tuple)) or len(item) != 2:
            raise ValueError("each wave_list item must be a (value, seconds) pair")
        value, seconds = item
        if seconds <= 0:
            raise ValueError("segment time must be > 0")
        out.append((float(value), max(1, int(seconds / cycle_time))))
    return out


def list_wave(i: str | Column, wave_list: Sequence[Sequence[float]] = LIST_WAVE_DEFAULT, cycle_time: float = DEFAULT_CYCLE_TIME) -> Column:
    """Piecewise-constant loop over ``(value, seconds)`` segments."""
    segs = list_segments(wave_list, cycle_time)
    total = sum(c for _, c in segs)
    r = F.pmod((F.col(i) if isinstance(i, str) else i).cast("long"), F.lit(total))
    expr, bound = None, 0
    for value, cycles in segs:
        bound += cycles
        expr = F.when(r < bound, F.lit(value)) if expr is None else expr.when(r < bound, F.lit(value))
    return expr.otherwise(F.lit(segs[-1][0]))


@dataclass(frozen=True)
class Wave:
    """One waveform instance of a generated dataset."""

    kind: str  # sine | square | triangle | list
    amplitude: float = WAVE_DEFAULTS["amplitude"]
    period: float = WAVE_DEFAULTS["period"]
    phase: float = WAVE_DEFAULTS["phase"]
    wave_list: tuple = field(default=LIST_WAVE_DEFAULT)

    def column(self, i: str | Column, cycle_time: float) -> Column:
        if self.kind == "sine":
            return sine(i, self.amplitude, self.period, self.phase, cycle_time)
        if self.kind == "square":
            return square(i, self.amplitude, self.period, self.phase, cycle_time)
        if self.kind == "triangle":
            return triangle(i, self.amplitude, self.period, self.phase, cycle_time)
        if self.kind == "list":
            return list_wave(i, self.wave_list, cycle_time)
        raise ValueError(f"unknown wave kind {self.kind!r}")

    def attributes(self) -> dict[str, float]:
        if self.kind == "list":
            return {}
        return {"amplitude": self.amplitude, "period": self.period, "phase": self.phase}


def waves_over_index(
    index: DataFrame,
    waves: Mapping[str, Wave],
    i: str = "i",
    cycle_time: float = DEFAULT_CYCLE_TIME,
    start_time: float = 0.0,
    sample_interval: float | None = None,
    time_format: str | None = None,
    with_attributes: bool = True,
) -> DataFrame:
    """Wide snapshot rows for a cycle index column ``i`` (0-based).

    Columns: ``cycle_count = i + 1``, ``need_sample`` (F5), ``time_str`` and
    ``sim_time = start + cycle_count * cycle_time`` (F6), then ``<name>.out``
    (+ constant attributes) per wave, in the given order.
    """
    if cycle_time <= 0:
        raise ValueError("cycle_time must be positive")
    cycle = (F.col(i) + 1).cast("int")
    st = _sim_time(cycle, cycle_time, start_time)
    cols = [
        cycle.alias("cycle_count"),
        sample_flag(cycle, cycle_time, sample_interval).alias("need_sample"),
        time_text(st, time_format).alias("time_str"),
        st.alias("sim_time"),
    ]
    for name, w in waves.items():
        cols.append(w.column(F.col(i), cycle_time).alias(f"{name}.out"))
        if with_attributes:
            cols.extend(F.lit(v).alias(f"{name}.{k}") for k, v in w.attributes().items())
    return index.select(*cols)


def generate(spark: SparkSession, n: int, waves: Mapping[str, Wave], num_partitions: int | None = None, **kw) -> DataFrame:
    """G1: ``n`` cycles (n > 0) of every wave; parallel over ``spark.range`` partitions."""
    if n <= 0:
        raise ValueError(f"generator needs n > 0, got {n}")
    idx = spark.range(0, n, 1, num_partitions) if num_partitions else spark.range(n)
    return waves_over_index(idx.withColumnRenamed("id", "i"), waves, "i", **kw)
