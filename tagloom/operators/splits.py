"""Literal split points: a total order cut into ranges of about equal size, as a column.

``repartitionByRange`` samples its bounds anew in every plan, so two passes over
the same rows only agree if the rows are written in between. Here a sample is taken
once, its quantiles go into the plan as literals, and ``SplitPoints.index`` gives
every row its range. Passes agree because the bounds are constants; nothing is
written, the rows keep their place, and a lost executor just computes them again.
The frame must give the same rows whenever it is computed.

No result depends on which bounds were drawn, only the balance does: a range holds
about ``rows / parts`` rows, however the values are spread. Equal keys stay together,
so an order with a unique last column can cut one hot instant, too.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: rows of a range, about
CHUNK_ROWS = 500_000
#: sampled rows a range, and in all (they come to the driver, keys only)
SAMPLE_A_PART, SAMPLE_MOST = 64, 1_000_000
#: up to so many bounds are a tree of comparisons in generated code; beyond, a fold searches the literal by halves
FEW = 63


def _literal(text: str | None, kind: T.DataType) -> str:
    if text is None:
        return f"cast(NULL AS {kind.simpleString()})"
    if isinstance(kind, T.StringType):
        return f"decode(X'{text.encode().hex()}', 'UTF-8')"
    return f"cast('{text}' AS {kind.simpleString()})"


def _at_least(cols: Sequence[str], bound: Sequence[str | None], kinds: Sequence[T.DataType]) -> Column:
    """Whether the key's first columns (nulls first, NaN last, as in Spark's order) are at least ``bound``; null counts as no."""
    out = None
    for c, text, kind in reversed(list(zip(cols, bound, kinds))):
        col, value = F.col(f"`{c}`"), F.expr(_literal(text, kind))
        if out is None:
            out = F.lit(True) if text is None else col >= value
        else:
            out = (col.isNotNull() if text is None else col > value) | (col.eqNullSafe(value) & out)
    return out


@dataclass(frozen=True)
class SplitPoints:
    """Bounds of ``len(bounds) + 1`` ranges of the order ``cols``; a bound belongs to the range above it.

    A bound names as many leading columns as it takes to tell it from other keys.
    """

    cols: tuple[str, ...]
    kinds: tuple[T.DataType, ...]
    bounds: tuple[tuple[str | None, ...], ...]

    @property
    def parts(self) -> int:
        return len(self.bounds) + 1

    def index(self) -> Column:
        """The row's range, from 0; non-decreasing along the order."""
        if len(self.bounds) <= FEW:
            return self._tree(0, len(self.bounds)).cast("long")
        width = max(map(len, self.bounds))
        # a missing column counts as below every value: nulls come first
        rows = (", ".join(f"{_literal(x, k)} AS c{i}" for i, (x, k) in enumerate(zip((*b, *[None] * (width - len(b))), self.kinds))) for b in self.bounds)
        table = F.expr("array(" + ", ".join(f"struct({r})" for r in rows) + ")")
        key = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(self.cols[:width])])
        known = F.struct(table.alias("t"), key.alias("k"))
        steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(self.bounds).bit_length()))])

        def search(x: Column) -> Column:
            below = lambda at, step: (at + step <= len(self.bounds)) & (F.get(x["t"], at + step - 1) <= x["k"])
            return F.aggregate(steps, F.lit(0), lambda at, step: F.when(below(at, step), at + step).otherwise(at))

        return F.element_at(F.transform(F.array(known), search), 1).cast("long")

    def _tree(self, low: int, high: int) -> Column:
        """Number of bounds at or below the key, known to be from ``low`` to ``high``."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(_at_least(self.cols, self.bounds[middle], self.kinds), self._tree(middle + 1, high)).otherwise(self._tree(low, middle))


def parts_for(rows: int, spark) -> int:
    """Ranges of about ``CHUNK_ROWS``, at least as many as shuffle partitions, and no more than a sample can bound."""
    return min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // CHUNK_ROWS)), SAMPLE_MOST // 8)


def split_points(df: DataFrame, order: Sequence[str], parts: int | None = None) -> SplitPoints:
    """Bounds for ``df`` in ascending ``order``; counts the rows and sorts a bounded sample of keys (two jobs)."""
    rows = df.count()
    parts = parts or parts_for(rows, df.sparkSession)
    kinds = tuple(df.schema[c].dataType for c in order)
    wanted = min(parts * SAMPLE_A_PART, SAMPLE_MOST)
    cols = [F.col(f"`{c}`") for c in order]
    # a margin, as the sample's size varies; sorted by the driver-side limit of Spark's own order
    sample = df.select(*cols) if rows <= wanted else df.select(*cols).sample(min(1.0, 1.1 * wanted / rows), seed=11)
    keys = [tuple(r) for r in sample.orderBy(*cols).select(*[c.cast("string") for c in cols]).collect()] if parts > 1 else []
    bounds: list[tuple] = []
    dense = max(2, len(keys) // (4 * parts))  # more sampled keys than this with equal leading columns take one column more
    for i in range(1, parts):
        at = i * len(keys) // parts
        if not 0 < at < len(keys):
            continue
        width = next((w for w in range(1, len(order)) if sum(k[:w] == keys[at][:w] for k in keys[max(0, at - dense) : at + dense + 1]) <= dense), len(order))
        if not bounds or bounds[-1] != keys[at][:width]:
            bounds.append(keys[at][:width])
    # in the order's sense a shorter bound comes before its continuations, so the list stays sorted once duplicates are gone
    return SplitPoints(tuple(order), kinds, tuple(dict.fromkeys(bounds)))
