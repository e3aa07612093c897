"""Rate-limited recurrences per series, solved chunk by chunk.

Step (valve travel / step-limited walk): move the state towards the target by
at most ``d`` (snap when within ``d``), then clamp to ``[lo, hi]``. As a map of
the state it is continuous and piecewise linear with slopes 0 and 1, and so is
every composition of steps: what a chunk does to its entry state is an *exit
map*, kept as its knots.

Plan (chunks are literal ranges of the order, so no row is written or moved but
for the groups themselves):

1. one aggregate carries the last target over chunk borders;
2. each chunk walks the paths from both ends of the range. Maps are monotone, so
   these bound its exits, and with that the entries of the next chunk. Where the
   paths meet, the usual case, the map is a constant, and the next entry is known;
   if they do in all chunks, step 6 follows;
3. the other chunks build their exit map, on the entries that can reach them only;
4. maps of up to ``FAN`` consecutive chunks compose to the map of a block, blocks to
   larger blocks, until one block covers a series; fewer, but two at least, where
   maps are large, so that a group holds about ``KNOTS`` knots;
5. entries go back down: the entry of a block, walked through its children's
   maps, gives theirs;
6. each chunk steps through its rows once from its entry.

Steps 4 and 5 take a logarithmic number of rounds over the chunk table, whatever
the targets do; no group holds more rows than a chunk. Sloped pieces of a map
differ in displacement by a multiple of ``d``, and a step adds two knots at most,
so a map has no more than about ``min(4 * width / d, 2 * rows)`` knots on the
``width`` of its entries. Entries may differ from step-by-step addition in the
last bits.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.operators.series import SeriesSpec, clamp, lay_out
from tagloom.session import materialize

#: exit maps composed in one group, and knots that they may have together
FAN, KNOTS = 64, 1_000_000

#: rows whose map is built step by step before maps are composed
_STRETCH = 1024

ExitMap = tuple[np.ndarray, np.ndarray]  # knots: entry states, increasing, and the exit states there


def travel_per_cycle(lo: float, hi: float, full_travel_time: float, cycle_time: float) -> float:
    """Longest move of one cycle; a range or travel time that is not positive sets no limit."""
    return cycle_time * (hi - lo) / full_travel_time if full_travel_time > 0 and hi > lo else math.inf


def limited_step(c: float, target: float, lo: float, hi: float, dist: float) -> float:
    """The point of the reachable interval ``[c - dist, c + dist]`` nearest to the target, kept in ``[lo, hi]``."""
    near = min(max(target, c - dist), c + dist)
    return min(max(near, lo), hi)


def compose(f: ExitMap, g: ExitMap) -> ExitMap:
    """``g`` after ``f``: the knots of ``f`` and the entries that ``f`` takes to knots of ``g``."""
    (fx, fy), (gx, gy) = f, g
    inside = gx[(gx > fy[0]) & (gx < fy[-1])]
    at = np.searchsorted(fy, inside)
    x = np.unique(np.concatenate([fx, np.minimum(fx[at - 1] + (inside - fy[at - 1]), fx[at])]))
    y = np.maximum.accumulate(np.interp(np.interp(x, fx, fy), gx, gy))
    flat = np.diff(y) < np.diff(x) / 2
    kept = np.ones(len(x), bool)
    kept[1:-1] = flat[1:] != flat[:-1]
    return x[kept], y[kept]


def _stretch_map(targets: Sequence[float], low: float, high: float, lo: float, hi: float, dist: float) -> ExitMap:
    """Exit map of consecutive steps on entries from ``low`` to ``high``."""
    first = targets[0]
    x = np.unique(np.clip([low, high, first - dist, first + dist, lo - dist, hi + dist], low, high))
    y = np.array([limited_step(c, first, lo, hi, dist) for c in x])
    for t in targets[1:]:
        # exits below t - d rise, those above t + d fall, what lies between becomes a plateau at t
        i, j = int(np.searchsorted(y, t - dist)), int(np.searchsorted(y, t + dist, "right"))
        if i == len(y):
            y = y + dist
        elif j == 0:
            y = y - dist
        else:
            begin = x[i - 1] + (t - dist - y[i - 1]) if i else x[0]
            end = x[j] - (y[j] - t - dist) if j < len(y) else x[-1]
            x = np.concatenate([x[:i], [begin, max(begin, end)], x[j:]])
            y = np.concatenate([y[:i] + dist, [t, t], y[j:] - dist])
    return x, y


def ends_of(targets: Sequence[float], lo: float, hi: float, dist: float, low: float, high: float) -> tuple[float, float]:
    """Exits of a chunk from the entries ``low`` and ``high``."""
    below, above = low, high
    for i, t in enumerate(targets):
        below, above = limited_step(below, t, lo, hi, dist), limited_step(above, t, lo, hi, dist)
        if above == below:  # every entry takes one path from here
            for u in targets[i + 1 :]:
                below = limited_step(below, u, lo, hi, dist)
            return below, below
    return below, above


def exit_map(targets: Sequence[float], lo: float, hi: float, dist: float, low: float, high: float) -> ExitMap:
    """Exit map of a chunk on entries from ``low`` to ``high``."""
    below, above = ends_of(targets, lo, hi, dist, low, high)
    if below == above or low == high:
        return np.array([low, high]), np.array([below, below])
    maps = [_stretch_map(targets[i : i + _STRETCH], low, high, lo, hi, dist) for i in range(0, len(targets), _STRETCH)]
    while len(maps) > 1:
        maps = [compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def fan_for(most: int) -> int:
    """Maps a group, if the largest has ``most`` knots."""
    return max(2, min(FAN, KNOTS // max(1, most)))


def _head(table: pa.Table, columns: Sequence[str], n: int = 1) -> dict[str, pa.Array]:
    """The columns' first value, ``n`` times."""
    return {c: pa.array([table[c][0].as_py()] * n, table.schema.field(c).type) for c in columns}


def _map_row(head: dict[str, pa.Array], found: ExitMap) -> pa.Table:
    return pa.table(head | {"_x": pa.array([found[0]], pa.list_(pa.float64())), "_y": pa.array([found[1]], pa.list_(pa.float64()))})


def _stored_map(table: pa.Table, row: int) -> ExitMap:
    return table["_x"][row].values.to_numpy(), table["_y"][row].values.to_numpy()


def _entries(maps: DataFrame, by: Sequence[str], chunks: int) -> DataFrame:
    """``_at`` and ``_entry`` of every chunk of the series ``by``, by composing maps upwards and walking entries down.

    Writes a small table a level; the number of levels is logarithmic in ``chunks``.
    """
    key_schema = [maps.schema[c] for c in by]
    map_schema = T.StructType([*key_schema, *(maps.schema[c] for c in ("_at", "_init", "_x", "_y"))])
    entry_schema = T.StructType([*key_schema, maps.schema["_at"], T.StructField("_entry", T.DoubleType())])

    def block_of(fan: int):
        def block(table: pa.Table) -> pa.Table:
            table = table.sort_by("_at")
            head = _head(table, [*by, "_init"]) | {"_at": pa.array([table["_at"][0].as_py() // fan], pa.int64())}
            found = reduce(compose, (_stored_map(table, i) for i in range(len(table))))
            return _map_row(head, found).select(map_schema.names)

        return block

    def children(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        state, entries = table["_entry"][0].as_py(), []
        for i in range(len(table)):
            entries.append(state)
            state = float(np.interp(state, *_stored_map(table, i)))
        columns = [table[c] for c in (*by, "_at")] + [pa.array(entries, pa.float64())]
        return pa.table(columns, names=entry_schema.names)

    levels, left = [], chunks
    while True:
        fan = fan_for(maps.agg(F.max(F.size("_x"))).first()[0] or 1)
        levels.append((maps, fan))
        left = -(-left // fan)
        if left <= 1:
            break
        maps = materialize(maps.groupBy(*by, F.floor(F.col("_at") / fan).alias("_block")).applyInArrow(block_of(fan), map_schema), "fold-block")
    entries = None
    for level, fan in reversed(levels):
        blocks = level.withColumn("_block", F.floor(F.col("_at") / fan))
        if entries is None:  # one block a series, entered at its initial value
            blocks = blocks.withColumn("_entry", F.col("_init"))
        else:
            blocks = blocks.join(entries.withColumnRenamed("_at", "_block"), [*by, "_block"])
        entries = materialize(blocks.select(*by, "_block", "_at", "_x", "_y", "_entry").groupBy(*by, "_block").applyInArrow(lambda _, t: children(t), entry_schema), "fold-entries")
    return entries


def chunked_fold(df: DataFrame, spec: SeriesSpec, target: Column, lo: float, hi: float, dist: float, initial: Column, out: str) -> DataFrame:
    """Per-series recurrence of the limited step over ``target``; a null holds the last one, at first ``initial``.

    Runs its jobs up to the chunks' entries while the plan is built, on the keys,
    the order and the target only. Columns that the step does not need travel
    through Arrow unchanged.
    """
    by, order = list(spec.by), list(spec.order)
    keep = [c for c in df.columns if c != "_chunk"]
    ascending = [(c, "ascending") for c in order]
    laid = lay_out(df, spec).withColumnRenamed("_chunk", "_at").withColumns({"_T": target.cast("double"), "_init": initial.cast("double")})
    # the chunk table: what each chunk holds at its start
    chunks = laid.groupBy(*by, "_at").agg(F.max_by("_T", F.when(F.col("_T").isNotNull(), spec.order_key())).alias("_last"), F.min("_init").alias("_init"))
    before = Window.partitionBy(*by).orderBy("_at")
    carry = F.last("_last", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1))
    chunks = chunks.select(*by, "_at", "_init", F.coalesce(carry, F.col("_init")).alias("_held"))
    knots = T.ArrayType(T.DoubleType())
    key_schema = [laid.schema[c] for c in (*by, "_at", "_init")]
    held_field = T.StructField("_held", T.DoubleType())
    end_schema = T.StructType([*key_schema, held_field, T.StructField("_low", T.DoubleType()), T.StructField("_high", T.DoubleType())])
    map_schema = T.StructType([*key_schema, T.StructField("_x", knots), T.StructField("_y", knots)])
    out_schema = T.StructType([*(laid.schema[c] for c in keep if c != out), T.StructField(out, T.DoubleType())])

    def held(table: pa.Table) -> tuple[pa.Table, list[float]]:
        """The rows in order, and their targets with nulls held."""
        table = table.sort_by(ascending)
        last, targets = table["_held"][0].as_py(), []
        for t in table["_T"].to_pylist():
            last = last if t is None else t
            targets.append(last)
        return table, targets

    def to_ends(table: pa.Table) -> pa.Table:
        table, targets = held(table)
        init = table["_init"][0].as_py()
        low, high = ends_of(targets, lo, hi, dist, min(lo, init), max(hi, init))
        return pa.table(_head(table, [*by, "_at", "_init", "_held"]) | {"_low": pa.array([low]), "_high": pa.array([high])})

    def to_map(table: pa.Table) -> pa.Table:
        table, targets = held(table)
        return _map_row(_head(table, [*by, "_at", "_init"]), exit_map(targets, lo, hi, dist, table["_elow"][0].as_py(), table["_ehigh"][0].as_py()))

    def to_rows(table: pa.Table) -> pa.Table:
        table, targets = held(table)
        path = list(accumulate(targets, lambda at, t: limited_step(at, t, lo, hi, dist), initial=table["_entry"][0].as_py()))
        return table.select(out_schema.names[:-1]).append_column(out, pa.array(path[1:], pa.float64()))

    key = [*by, "_at"]
    columns = laid.select(*list(dict.fromkeys([*key, *order, "_T"])))
    ends = materialize(columns.join(chunks, key).groupBy(*key).applyInArrow(lambda _, t: to_ends(t), end_schema), "fold-ends")
    # a chunk is entered between the exits of the one before, the first one at the initial value
    entered = {f"_e{c}": F.coalesce(F.lag(f"_{c}").over(before), F.col("_init")) for c in ("low", "high")}
    ends = ends.withColumns(entered)
    met = F.col("_low") == F.col("_high")
    if ends.where(~met).isEmpty():  # then every entry is known already
        info = ends.select(*key, "_held", F.col("_elow").alias("_entry"))
        return laid.join(info, key).groupBy(*key).applyInArrow(lambda _, t: to_rows(t), out_schema)
    known = ends.where(met).select(*key, "_init", F.array("_elow", "_ehigh").alias("_x"), F.array("_low", "_low").alias("_y"))
    wanted = ends.where(~met).select(*key, "_init", "_held", "_elow", "_ehigh")
    built = columns.join(wanted, key).groupBy(*key).applyInArrow(lambda _, t: to_map(t), map_schema)
    maps = materialize(known.unionByName(built), "fold-maps")
    # places without gaps a series, so that blocks are full
    places = maps.select(*key, (F.row_number().over(before) - 1).cast("long").alias("_place"))
    maps = maps.join(places, key).drop("_at").withColumnRenamed("_place", "_at").select(*map_schema.names)
    most = places.agg(F.max("_place")).first()[0]
    entries = _entries(maps, by, (most or 0) + 1).withColumnRenamed("_at", "_place").join(places, [*by, "_place"]).drop("_place")
    info = entries.join(ends.select(*key, "_held"), key)
    return laid.join(info, key).groupBy(*key).applyInArrow(lambda _, t: to_rows(t), out_schema)


def slew_limit(
    df: DataFrame,
    spec: SeriesSpec,
    target_col: str,
    min_opening: float = 0.0,
    max_opening: float = 100.0,
    full_travel_time: float = 10.0,
    cycle_time: float = 0.5,
    initial_opening: float = 0.0,
    out: str = "current_opening",
) -> DataFrame:
    """Valve opening per row; target clamped, NULL target holds the last one (initially ``initial_opening``).

    Travel per cycle = (max - min) / full_travel_time * cycle_time; non-positive
    travel time or range means instantaneous moves.
    """
    dist = travel_per_cycle(min_opening, max_opening, full_travel_time, cycle_time)
    target = clamp(F.col(target_col).cast("double"), min_opening, max_opening)
    return chunked_fold(df, spec, target, min_opening, max_opening, dist, F.lit(float(initial_opening)), out)


def uniform(seed: int, *cols: Column) -> Column:
    """Deterministic uniform [0, 1) from a 64-bit hash (53 bits)."""
    h = F.xxhash64(F.lit(seed), *cols)
    return F.abs(h % F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def random_walk(df: DataFrame, spec: SeriesSpec, L: float = 0.0, H: float = 100.0, max_step: float = 3.0, seed: int = 0, out: str = "out") -> DataFrame:
    """R2: step-limited random walk; target uniform in [L, H] per row, start uniform per series."""
    key = [F.col(c) for c in spec.by]
    tgt = F.lit(L) + F.lit(H - L) * uniform(seed, *key, *[F.col(c) for c in spec.order])
    init = F.lit(L) + F.lit(H - L) * uniform(seed + 1, *key)
    return chunked_fold(df, spec, tgt, L, H, float(max_step), init, out)
