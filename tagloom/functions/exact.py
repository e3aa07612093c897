"""Sums of doubles that are exact until one final rounding, so they do not depend on the order or the partitioning.

A double is an integer times a power of two. ``limbs`` scales it by the power of the
32-exponent *bin* it lies in to an integer below 2^86 and cuts that into two of 43
bits; per bin these add up as DECIMAL(38,0) without error, whatever the order
(2^40 rows and more). ``rounded_sum`` merges the bins of a group, few unless its
values span hundreds of orders of magnitude, and rounds once, to the double nearest
to the true sum; so does ``rounded_mean``. NaN and infinities follow the usual rules,
a sum beyond the largest double is infinite.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_WIDTH, _CUT = 32, 43
#: bins of the doubles: |x| in [2^(32 b), 2^(32 b + 32))
_LEAST, _MOST = -34, 31
#: every limb is a multiple of 2^-_UNIT
_UNIT = 53 - _WIDTH * _LEAST


def bin_of(value: Column) -> Column:
    """Bin of a finite double; zero lies in bin 0. A value within rounding of a border may lie in either."""
    b = F.floor(F.log2(F.abs(value)) / F.lit(float(_WIDTH))).cast("int")
    return F.when(value == 0, F.lit(0)).otherwise(F.greatest(F.lit(_LEAST), F.least(F.lit(_MOST), b)))


def limbs(value: Column, b: Column) -> tuple[Column, Column]:
    """High and low 43 bits of a finite double of bin ``b`` as an integer of unit ``2^(32 b - 53)``."""
    # two factors: one alone would overflow for the smallest bins
    halves = [divmod(53 - _WIDTH * i, 2) for i in range(_LEAST, _MOST + 1)]
    first = F.array(*[F.lit(2.0**q) for q, _ in halves])
    second = F.array(*[F.lit(2.0 ** (q + r)) for q, r in halves])
    at = b - _LEAST
    x = value * F.get(first, at) * F.get(second, at)
    high = F.floor(x / F.lit(2.0**_CUT))
    low = x - high.cast("double") * F.lit(2.0**_CUT)
    return high.cast("long"), low.cast("long")


def _total(parts) -> int:
    return sum(((int(p["high"]) << _CUT) + int(p["low"])) << (_WIDTH * (p["bin"] - _LEAST)) for p in parts)


def _rounded(total: int, n: int) -> float:
    """``total / (n 2^_UNIT)``, rounded once: Python divides integers correctly rounded."""
    try:
        return total / (n << _UNIT)
    except OverflowError:
        return float("inf") if total > 0 else float("-inf")


@F.pandas_udf(DoubleType())
def _rounded_parts(parts: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([_rounded(_total(p), int(c)) for p, c in zip(parts, n)], dtype="float64")


def rounded_mean(parts: Column, special: Column, n: Column) -> Column:
    """Mean of a group of ``n`` values from its ``array<struct<bin, high, low>>``, rounded once; ``special``, if that is not 0."""
    return F.when(special != 0, special).otherwise(_rounded_parts(parts, n))


def rounded_sum(parts: Column, special: Column) -> Column:
    return rounded_mean(parts, special, F.lit(1))


def special_of(value: Column) -> Column:
    """0 for finite sums; what NaN and infinities add up to otherwise (an aggregate: the sum of them alone)."""
    return F.coalesce(F.sum(F.when(~is_finite(value), value)), F.lit(0.0))


def is_finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def exact_sums(df: DataFrame, by: list[str], value: Column, *others: Column) -> DataFrame:
    """``by``, the partial aggregates ``others`` (mergeable by max), ``n``, ``sum`` and ``avg`` of ``value`` (nulls left out).

    Two hash aggregates: by group and bin (map-side partial), then by group.
    """
    v = value.cast("double")
    b = F.when(is_finite(v), bin_of(v))
    rows = df.withColumn("_v", v).withColumn("_b", b)
    high, low = limbs(F.col("_v"), F.col("_b"))
    whole = F.col("_b").isNotNull()
    binned = rows.groupBy(*by, "_b").agg(
        F.count("_v").alias("_n"), special_of(F.col("_v")).alias("_s"),
        F.sum(F.when(whole, high).cast("decimal(20,0)")).alias("_h"), F.sum(F.when(whole, low).cast("decimal(20,0)")).alias("_l"), *others,
    )
    part = F.when(F.col("_b").isNotNull(), F.struct(F.col("_b").alias("bin"), F.col("_h").cast("string").alias("high"), F.col("_l").cast("string").alias("low")))
    names = [n for n in binned.columns if n not in {*by, "_b", "_n", "_s", "_h", "_l"}]
    found = binned.groupBy(*by).agg(F.sum("_n").alias("n"), F.collect_list(part).alias("_p"), F.sum("_s").alias("_s"), *[F.struct(F.min(n).alias("min"), F.max(n).alias("max"), F.sum(n).alias("sum")).alias(n) for n in names])
    some = F.col("n") > 0
    # the functions run on all rows: groups without values divide by one
    total, mean = rounded_sum(F.col("_p"), F.col("_s")), rounded_mean(F.col("_p"), F.col("_s"), F.greatest("n", F.lit(1)))
    return found.withColumns({"sum": total, "avg": mean}).withColumns({"sum": F.when(some, F.col("sum")), "avg": F.when(some, F.col("avg"))}).drop("_p", "_s")
