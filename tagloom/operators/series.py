"""Per-series ordered operators: lag, hold-last, integral, first difference, clamp, PID.

Layout
------
A naive ``Window.partitionBy(series)`` puts a whole series in one task, so a
tag holding a third of the table would run on one core. Every operator here
instead cuts each series into *chunks* along its order. Chunks are cut by the
data: literal split points (:mod:`tagloom.operators.splits`) cut the order
(series, order) into ranges of about ``CHUNK_ROWS`` rows, and the range is the
chunk, so neither a hot series nor a dense day makes a large group. Nothing is
written and no row moves for it. (A spec with an explicit ``chunk_size`` cuts by
fixed width instead; its groups then grow with the data.)

1. the window runs per ``(series, chunk)`` (a bounded group, spread by hash
   over all tasks);
2. a per-chunk summary (sum, last value, row count) is aggregated with
   partial aggregation, then scanned per series over the *chunk table*, which
   is smaller than the data by the chunk size;
3. the carry joins back on ``(series, chunk)``: the data side is already hash
   partitioned on exactly those keys by step 1, so only the small chunk table
   moves.

Results are exact for hold-last, lag and first difference; running sums add the
same terms in a different order (last-bit float differences). A row without a series
key belongs to no series and does not come out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions import exact
from tagloom.operators.splits import CHUNK_ROWS, split_points  # noqa: F401  (the chunk size is part of this module's interface)

_MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})"


@dataclass(frozen=True)
class SeriesSpec:
    """Series key, total order inside a series, and the chunk key.

    ``order`` must be unique inside a series (add an id as tie-breaker).
    ``chunk`` must be non-decreasing along ``order`` within a series; None cuts by the data.
    """

    by: tuple[str, ...]
    order: tuple[str, ...]
    chunk: Column | None
    key: Column | None = None  # fixed-width ordering key (see series_spec)

    def order_cols(self) -> list[Column]:
        return [F.col(c) for c in self.order]

    def order_key(self) -> Column:
        """Ordering for max_by/min_by: a fixed-width key keeps the aggregate hash-based."""
        return self.key if self.key is not None else F.struct(*self.order_cols())


def series_spec(df: DataFrame, by: Sequence[str], order: Sequence[str], chunk_size: float | int | None = None) -> SeriesSpec:
    """Build a spec whose chunks are cut by the data, or by ``floor(first order column / chunk_size)``.

    Timestamps chunk on epoch microseconds (``chunk_size`` in seconds), numbers on their value.
    """
    if chunk_size is None:
        return SeriesSpec(tuple(by), tuple(order), None, _fixed_width_key(df, order))
    first = order[0]
    dtype = df.schema[first].dataType
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        c = F.col(first).cast("timestamp_ntz") if not isinstance(dtype, T.TimestampNTZType) else F.col(first)
        micros = F.expr(_MICROS.format(c="`" + first + "`")) if isinstance(dtype, T.TimestampNTZType) else F.unix_micros(F.col(first).cast("timestamp"))
        chunk = F.floor(micros / F.lit(float(chunk_size) * 1e6))
    else:
        chunk = F.floor(F.col(first) / F.lit(chunk_size))
    return SeriesSpec(tuple(by), tuple(order), chunk, _fixed_width_key(df, order))


_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _as_long(df: DataFrame, c: str) -> Column | None:
    dtype = df.schema[c].dataType
    if isinstance(dtype, _INTEGRAL):
        return F.col(c).cast("long")
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType)):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz"))
    return None


def _fixed_width_key(df: DataFrame, order: Sequence[str]) -> Column | None:
    """One numeric key with the lexicographic order of ``order`` when possible.

    One numeric/timestamp column: itself. Two columns (integral/timestamp, then
    a non-negative integral tie-breaker below 10^19): ``a * 10^19 + b`` as
    DECIMAL(38,0). Otherwise None (struct ordering, sort aggregate).
    """
    if len(order) == 1:
        dtype = df.schema[order[0]].dataType
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            return F.col(order[0])
        return _as_long(df, order[0])
    if len(order) == 2 and isinstance(df.schema[order[1]].dataType, _INTEGRAL):
        a = _as_long(df, order[0])
        if a is not None:
            span = F.lit("10000000000000000000").cast("decimal(38,0)")
            return a.cast("decimal(38,0)") * span + F.col(order[1]).cast("decimal(38,0)")
    return None


def lay_out(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """``df`` with its ``_chunk``; a frame that has one keeps it, so several operators can share a layout.

    Counts the rows and sorts a sample of keys while the plan is built.
    """
    if "_chunk" in df.columns:
        return df
    if spec.chunk is not None:
        return df.withColumn("_chunk", spec.chunk.cast("long"))
    return df.withColumn("_chunk", split_points(df, [*spec.by, *spec.order]).index())


def _without_layout(out: DataFrame, df: DataFrame) -> DataFrame:
    return out if "_chunk" in df.columns else out.drop("_chunk")


def _chunked(df: DataFrame, spec: SeriesSpec) -> tuple[DataFrame, Window]:
    d = lay_out(df, spec)
    w = Window.partitionBy(*spec.by, "_chunk").orderBy(*spec.order_cols())
    return d, w


def _chunk_window(spec: SeriesSpec) -> Window:
    return Window.partitionBy(*spec.by).orderBy("_chunk")


def running_sum(df: DataFrame, spec: SeriesSpec, value: Column, out: str) -> DataFrame:
    """W3 building block: inclusive running sum of ``value`` per series."""
    d, w = _chunked(df, spec)
    d = d.withColumn("_v", value)
    d = d.withColumn("_in", F.sum("_v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    tot = d.groupBy(*spec.by, "_chunk").agg(F.sum("_v").alias("_tot"))
    carry = tot.select(
        *spec.by,
        "_chunk",
        F.coalesce(F.sum("_tot").over(_chunk_window(spec).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_carry"),
    )
    res = d.join(carry, [*spec.by, "_chunk"]).withColumn(out, F.col("_in") + F.col("_carry"))
    return _without_layout(res.drop("_v", "_in", "_carry"), df)


def running_sum_exact(df: DataFrame, spec: SeriesSpec, value: Column, out: str) -> DataFrame:
    """Inclusive running sum per series, rounded once a row: the same to the last bit on any layout.

    The limbs of :mod:`tagloom.functions.exact` are summed per bin, a column each for
    the bins that occur (one aggregate finds them, a few unless values span hundreds
    of orders of magnitude). Nulls add nothing; from the first NaN or infinity on,
    the sum is what these add up to.
    """
    v = value.cast("double")
    d, w = _chunked(df.withColumn("_v", v), spec)
    d = d.withColumn("_b", F.when(exact.is_finite(F.col("_v")), exact.bin_of(F.col("_v"))))
    bins = sorted(r[0] for r in d.select("_b").distinct().collect() if r[0] is not None)
    high, low = exact.limbs(F.col("_v"), F.col("_b"))
    zero = F.lit(0).cast("decimal(20,0)")
    terms = {"_odd": F.when(exact.is_finite(F.col("_v")) | F.col("_v").isNull(), F.lit(0.0)).otherwise(F.col("_v"))}
    for i, b in enumerate(bins):
        mine = F.coalesce(F.col("_b") == b, F.lit(False))
        terms |= {f"_h{i}": F.when(mine, high.cast("decimal(20,0)")).otherwise(zero), f"_l{i}": F.when(mine, low.cast("decimal(20,0)")).otherwise(zero)}
    d = d.withColumns(terms)
    totals = d.groupBy(*spec.by, "_chunk").agg(*[F.sum(t).alias(t) for t in terms])
    before = _chunk_window(spec).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*spec.by, "_chunk", *[F.sum(t).over(before).alias(f"_c{t}") for t in terms])
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    res = d.withColumns({t: F.sum(t).over(upto) for t in terms}).join(carry, [*spec.by, "_chunk"])
    so_far = {t: F.col(t) + F.coalesce(F.col(f"_c{t}"), F.lit(0)) for t in terms}
    parts = F.array(*[F.struct(F.lit(b).alias("bin"), so_far[f"_h{i}"].cast("string").alias("high"), so_far[f"_l{i}"].cast("string").alias("low")) for i, b in enumerate(bins)])
    parts = parts if bins else F.array().cast("array<struct<bin:int,high:string,low:string>>")
    res = res.withColumns({"_p": parts, "_s": so_far["_odd"]}).withColumn(out, exact.rounded_sum(F.col("_p"), F.col("_s")))
    return _without_layout(res.drop("_v", "_b", "_p", "_s", *terms, *[f"_c{t}" for t in terms]), df)


def hold_last(df: DataFrame, spec: SeriesSpec, col: str, initial: float | None = 0.0, out: str | None = None) -> DataFrame:
    """NULL input keeps the previous non-NULL value of the series; before any, ``initial``."""
    out = out or col
    d, w = _chunked(df, spec)
    d = d.withColumn("_in", F.last(F.col(col), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last_in_chunk = d.groupBy(*spec.by, "_chunk").agg(
        F.max_by(F.col(col), F.when(F.col(col).isNotNull(), spec.order_key())).alias("_last")
    )
    carry = last_in_chunk.select(
        *spec.by,
        "_chunk",
        F.last("_last", ignorenulls=True).over(_chunk_window(spec).rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"),
    )
    init = F.lit(initial).cast("double") if initial is not None else F.lit(None).cast("double")
    res = d.join(carry, [*spec.by, "_chunk"]).withColumn(out, F.coalesce(F.col("_in"), F.col("_carry"), init))
    return _without_layout(res.drop("_in", "_carry"), df)


def previous_value(df: DataFrame, spec: SeriesSpec, col: str, default: float = 0.0, out: str = "_prev") -> DataFrame:
    """Value of ``col`` on the previous row of the series (``default`` on the first row)."""
    d, w = _chunked(df, spec)
    d = d.withColumn("_in", F.lag(F.col(col), 1).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    last_in_chunk = d.groupBy(*spec.by, "_chunk").agg(F.max_by(F.col(col), spec.order_key()).alias("_last"))
    carry = last_in_chunk.select(*spec.by, "_chunk", F.lag("_last", 1).over(_chunk_window(spec)).alias("_carry"), F.lag("_chunk", 1).over(_chunk_window(spec)).alias("_pc"))
    res = d.join(carry, [*spec.by, "_chunk"])
    val = F.when(F.col("_first"), F.when(F.col("_pc").isNull(), F.lit(default)).otherwise(F.col("_carry"))).otherwise(F.col("_in"))
    return _without_layout(res.withColumn(out, val).drop("_in", "_first", "_carry", "_pc"), df)


def lag(
    df: DataFrame,
    spec: SeriesSpec,
    col: str,
    n: int,
    default: float = 0.0,
    out: str | None = None,
    inclusive: bool = False,
    initial: float | None = None,
) -> DataFrame:
    """Value ``n`` rows back in the series, ``default`` when history is too short.

    ``x[-n]`` and ``x[n]`` mean the same (the sign is ignored); ``n = 0`` is the
    current value. ``inclusive=True`` gives the executed meaning of a buffer
    that already holds the current value (``n - 1`` back). ``initial`` seeds
    one value before the first row (the cycle-0 value).

    """
    return lag_many(df, spec, [(col, n, out or f"{col}_lag{abs(n)}")], default, inclusive, initial)


def lag_many(
    df: DataFrame,
    spec: SeriesSpec,
    lags: Sequence[tuple[str, int, str]],
    default: float = 0.0,
    inclusive: bool = False,
    initial: float | None = None,
) -> DataFrame:
    """W1 for several ``(column, n, name)`` in one chunked pass, whatever their number.

    Rows past the first n of their chunk take the in-chunk lag. The chunk table
    carries the last rows of each chunk (as many as the longest lag); the rows
    before a chunk come from the tails of as many chunks before it, so a chunk
    may be shorter than the lag.
    """
    plan = [(col, abs(int(n)) - (1 if inclusive else 0), out) for col, n, out in lags]
    deep = max((k for _, k, _ in plan), default=0)
    for col, _, out in (p for p in plan if p[1] <= 0):
        df = df.withColumn(out, F.col(f"`{col}`").cast("double"))
    plan = [p for p in plan if p[1] > 0]
    if not plan:
        return df
    d, w = _chunked(df, spec)
    sources = list(dict.fromkeys(col for col, _, _ in plan))
    d = d.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*spec.by, "_chunk")))
    d = d.withColumns({f"_in{j}": F.lag(F.col(f"`{col}`").cast("double"), k).over(w) for j, (col, k, _) in enumerate(plan)})
    tail = F.struct("_i", *[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(sources)])
    tails = d.filter(F.col("_i") > F.col("_n") - deep).groupBy(*spec.by, "_chunk").agg(F.array_sort(F.collect_list(tail)).alias("_t"))
    before = F.flatten(F.collect_list("_t").over(_chunk_window(spec).rowsBetween(-deep, -1)))
    carry = tails.select(*spec.by, "_chunk", before.alias("_b"))
    carry = carry.withColumn("_b", F.slice("_b", F.greatest(F.size("_b") - F.lit(deep - 1), F.lit(1)), deep))
    res = d.join(carry, [*spec.by, "_chunk"])
    held = F.size("_b")
    outs = {}
    for j, (col, k, out) in enumerate(plan):
        back = F.lit(k + 1) - F.col("_i")  # the row wanted, counted from the end of what comes before the chunk
        fallback = F.lit(default).cast("double")
        if initial is not None:
            fallback = F.when(back == held + 1, F.lit(initial).cast("double")).otherwise(fallback)
        old = F.get("_b", held - back)[f"v{sources.index(col)}"]
        outs[out] = F.when(F.col("_i") > k, F.col(f"_in{j}")).when(back <= held, old).otherwise(fallback)
    res = res.withColumns(outs).drop("_i", "_n", "_b", *[f"_in{j}" for j in range(len(plan))])
    return _without_layout(res, df)


def clamp(x: Column, lo: Column | float, hi: Column | float) -> Column:
    """``max(lo, min(hi, x))``; NULL stays NULL (Spark's least/greatest would skip it)."""
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(lo, F.least(hi, x)))


# PID defaults.
PID_DEFAULTS = {"PB": 12.0, "TI": 30.0, "TD": 0.15, "H": 100.0, "L": 0.0, "PV": 0.0, "SV": 0.0}


def hold_last_many(df: DataFrame, spec: SeriesSpec, cols: dict[str, tuple[str, float | None]]) -> DataFrame:
    """W2 for several columns in one chunked pass: ``{out: (col, initial)}``."""
    d, w = _chunked(df, spec)
    frame = w.rowsBetween(Window.unboundedPreceding, 0)
    for out, (col, _) in cols.items():
        d = d.withColumn(f"_in_{out}", F.last(F.col(col), ignorenulls=True).over(frame))
    lasts = d.groupBy(*spec.by, "_chunk").agg(
        *[F.max_by(F.col(col), F.when(F.col(col).isNotNull(), spec.order_key())).alias(f"_last_{out}") for out, (col, _) in cols.items()]
    )
    prev = _chunk_window(spec).rowsBetween(Window.unboundedPreceding, -1)
    carry = lasts.select(*spec.by, "_chunk", *[F.last(f"_last_{out}", ignorenulls=True).over(prev).alias(f"_c_{out}") for out in cols])
    res = d.join(carry, [*spec.by, "_chunk"])
    for out, (_, init) in cols.items():
        res = res.withColumn(out, F.coalesce(F.col(f"_in_{out}"), F.col(f"_c_{out}"), F.lit(init).cast("double")))
    return _without_layout(res.drop(*[f"_in_{o}" for o in cols], *[f"_c_{o}" for o in cols]), df)


def pid_response(
    df: DataFrame,
    spec: SeriesSpec,
    pv: str,
    sv: str | float,
    cycle_time: float = 0.5,
    PB: float = PID_DEFAULTS["PB"],
    TI: float = PID_DEFAULTS["TI"],
    TD: float = PID_DEFAULTS["TD"],
    H: float = PID_DEFAULTS["H"],
    L: float = PID_DEFAULTS["L"],
    PV0: float = PID_DEFAULTS["PV"],
    SV0: float = PID_DEFAULTS["SV"],
) -> DataFrame:
    """PID output over recorded PV/SV, one row per cycle of each series.

    error e = SV - PV (NULL inputs hold the last value, W2); integral = running
    sum of e * dt (W3); rate = (e - e_prev) / dt with e_prev = 0 first (W4);
    MV = clamp(PB*e + PB/TI*integral + PB*TD*rate, L, H) (W5). The clamped MV
    never feeds back, so the controller is an exact window composition.
    Two chunked passes: held PV/SV, then integral and previous error together.
    Adds ``error``, ``integral``, ``derivative``, ``mv``.
    """
    holds = {"_pv": (pv, PV0)}
    if isinstance(sv, str):
        holds["_sv"] = (sv, SV0)
    d = hold_last_many(lay_out(df, spec), spec, holds)
    if not isinstance(sv, str):
        d = d.withColumn("_sv", F.lit(float(sv)))
    d = d.withColumn("error", F.col("_sv") - F.col("_pv"))
    # pass 2: running sum of e*dt and previous e, sharing one window and one chunk table
    d, w = _chunked(d, spec)
    d = d.withColumn("_v", F.col("error") * F.lit(cycle_time))
    d = d.withColumn("_in", F.sum("_v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_lag", F.lag("error", 1).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    summ = d.groupBy(*spec.by, "_chunk").agg(F.sum("_v").alias("_tot"), F.max_by("error", spec.order_key()).alias("_last"))
    cw = _chunk_window(spec)
    carry = summ.select(
        *spec.by,
        "_chunk",
        F.coalesce(F.sum("_tot").over(cw.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_carry"),
        F.coalesce(F.lag("_last", 1).over(cw), F.lit(0.0)).alias("_plast"),
    )
    d = d.join(carry, [*spec.by, "_chunk"])
    d = d.withColumn("integral", F.col("_in") + F.col("_carry"))
    d = d.withColumn("_eprev", F.when(F.col("_first"), F.col("_plast")).otherwise(F.col("_lag")))
    d = d.withColumn("derivative", (F.col("error") - F.col("_eprev")) / F.lit(cycle_time))
    i_term = F.lit(PB / TI) * F.col("integral") if TI > 0 else F.lit(0.0)
    raw = F.lit(PB) * F.col("error") + i_term + F.lit(PB * TD) * F.col("derivative")
    return d.withColumn("mv", clamp(raw, L, H)).drop("_pv", "_sv", "_eprev", "_v", "_in", "_lag", "_first", "_carry", "_plast", *([] if "_chunk" in df.columns else ["_chunk"]))
