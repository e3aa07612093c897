"""History queries: filter + top-k, statistics, latest values, tag catalog, page slice.

All are single-pass DataFrame plans. Filters are plain comparisons on scan
columns so Catalyst pushes them into the parquet reader (and onto the ``date``
partition column when the table is partitioned). Aggregates are partial +
final hash aggregates, so a tag holding a third of all rows is pre-reduced on
every map task before the shuffle.
"""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions.exact import exact_sums
from tagloom.schema import HISTORY_COLUMNS

_DATE_FOLDER = re.compile(r"/date=(\d{4}-\d\d-\d\d)/[^/]*$")


def _lit_ts(value) -> Column:
    """A zone-less timestamp literal: text -> TIMESTAMP_NTZ never goes through the session zone."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        value = _dt.datetime.fromisoformat(value)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def _micros_of(value) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _lit_ts(value))


def history_filter(
    history: DataFrame,
    param_name: str | None = None,
    instance_name: str | None = None,
    start_time=None,
    end_time=None,
) -> DataFrame:
    """AND of the given predicates; a falsy argument (None, "") adds none. Bounds inclusive.

    When the table carries the ``date`` partition column, matching date bounds
    are added so that partitions are pruned; with ``epoch_us``, bounds that Parquet
    can compare with those of a row group (it is null in files without it).
    """
    cond = F.lit(True)
    if param_name:
        cond = cond & (F.col("param_name") == F.lit(param_name))
    if instance_name:
        cond = cond & (F.col("instance_name") == F.lit(instance_name))
    has_date, has_us = "date" in history.columns, "epoch_us" in history.columns
    us = F.col("epoch_us")
    if start_time:
        cond = cond & (F.col("timestamp") >= _lit_ts(start_time))
        if has_date:
            cond = cond & (F.col("date") >= F.to_date(_lit_ts(start_time)))
        if has_us:
            cond = cond & (us.isNull() | (us >= _micros_of(start_time)))
    if end_time:
        cond = cond & (F.col("timestamp") <= _lit_ts(end_time))
        if has_date:
            cond = cond & (F.col("date") <= F.to_date(_lit_ts(end_time)))
        if has_us:
            cond = cond & (us.isNull() | (us <= _micros_of(end_time)))
    return history.filter(cond)


def partition_dates(history: DataFrame) -> list[_dt.date]:
    """Dates of the folders that a stored history table has, newest first (none for other frames): the file listing only."""
    if "date" not in history.columns:
        return []
    found = {_DATE_FOLDER.search(f) for f in history.inputFiles()}
    return [] if None in found else sorted({_dt.date.fromisoformat(m[1]) for m in found}, reverse=True)


def newest_dates(rows: DataFrame, dates: list[_dt.date], limit: int) -> DataFrame:
    """``rows`` (filtered, of a stored table) from the oldest date on that their newest ``limit`` can lie on.

    Walks the dates from the newest, one, two, four ... more at a time, and counts
    what the filter leaves of each, until ``limit`` rows are certain. The counts read
    the filter's columns of those dates only.
    """
    at, step, found = 0, 1, 0
    while at < len(dates):
        some = dates[at : at + step]
        inside = F.col("date").between(F.lit(some[-1]), F.lit(some[0]))
        for r in sorted(rows.filter(inside).groupBy("date").count().collect(), key=lambda r: r["date"], reverse=True):
            found += r["count"]
            if found >= limit:
                return rows.filter(F.col("date") >= F.lit(r["date"]))
        at, step = at + step, step * 2
    return rows


def query_history(
    history: DataFrame,
    param_name: str | None = None,
    instance_name: str | None = None,
    start_time=None,
    end_time=None,
    limit: int | None = 1000,
) -> DataFrame:
    """filtered rows, newest first, at most ``limit`` (None: all; ties broken by id, newest first).

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: each task keeps
    its own top n, only n rows per task reach the final merge. Of a stored table
    only the newest dates that hold ``limit`` rows are read (counted while the plan
    is built).
    """
    rows = history_filter(history, param_name, instance_name, start_time, end_time)
    if limit is not None:
        dates = partition_dates(history)
        last = [_day_of(t) for t in (start_time, end_time)]
        dates = [d for d in dates if (last[0] is None or d >= last[0]) and (last[1] is None or d <= last[1])]
        rows = newest_dates(rows, dates, limit) if len(dates) > 1 else rows
    ordered = rows.select(*HISTORY_COLUMNS).orderBy(F.desc("timestamp"), F.desc("id"))
    return ordered if limit is None else ordered.limit(limit)


def _day_of(value) -> _dt.date | None:
    """The date of a bound that is known on the driver."""
    if not value or isinstance(value, Column):
        return None
    return (_dt.datetime.fromisoformat(value) if isinstance(value, str) else value).date()


def iso_timestamp(col: str | Column = "timestamp") -> Column:
    """ISO-8601 text (``YYYY-MM-DDTHH:MM:SS[.ffffff]``, fraction omitted when zero)."""
    c = F.col(col) if isinstance(col, str) else col
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    # whole seconds decided arithmetically: one date_format per row
    return F.when(F.pmod(us, F.lit(1_000_000)) == 0, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )


def statistics(history: DataFrame, param_name: str, start_time=None, end_time=None) -> DataFrame:
    """A1: one row ``param_name, count, min, max, avg, sum``; empty input -> count 0 and NULLs."""
    rows = history_filter(history, param_name=param_name, start_time=start_time, end_time=end_time)
    return rows.agg(*_stat_aggs()).select(F.lit(param_name).alias("param_name"), "count", "min", "max", "avg", "sum")


def _stat_aggs() -> list[Column]:
    v = F.col("param_value")
    return [
        F.count(F.lit(1)).alias("count"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.avg(v).alias("avg"),
        F.sum(v).alias("sum"),
    ]


def statistics_by_tag(history: DataFrame, start_time=None, end_time=None) -> DataFrame:
    """A1 for every tag at once (A2's per-tag count included): one partial+final hash aggregate."""
    rows = history_filter(history, start_time=start_time, end_time=end_time)
    return rows.groupBy("param_name").agg(*_stat_aggs())


def statistics_exact(history: DataFrame, start_time=None, end_time=None) -> DataFrame:
    """A1 for every tag with sums and means that are rounded once: the same to the last bit on any partitioning."""
    rows = history_filter(history, start_time=start_time, end_time=end_time)
    v = F.col("param_value")
    found = exact_sums(rows, ["param_name"], v, F.count(F.lit(1)).alias("count"), F.min(v).alias("least"), F.max(v).alias("most"))
    return found.select("param_name", F.col("count.sum").alias("count"), F.col("least.min").alias("min"), F.col("most.max").alias("max"), "avg", "sum")


def records_per_tag(history: DataFrame) -> DataFrame:
    """A2: number of records per tag."""
    return history.groupBy("param_name").agg(F.count(F.lit(1)).alias("records"))


_ID_SPAN = "10000000000000000000"  # 10^19 > any non-negative BIGINT id


def time_id_key(ts: str = "timestamp", id_col: str = "id") -> Column:
    """Lexicographic (timestamp, id) as one ``DECIMAL(38,0)``: ``epoch_us * 10^19 + id``.

    Exact for ids in ``[0, 10^19)``. Unlike a struct, a decimal ordering keeps
    ``max_by``/``min_by`` in a hash aggregate (a struct buffer forces a sort
    aggregate, i.e. a sort of every map task's rows).
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    us = F.timestamp_diff("MICROSECOND", epoch, F.col(ts)).cast("decimal(38,0)")
    return us * F.lit(_ID_SPAN).cast("decimal(38,0)") + F.col(id_col).cast("decimal(38,0)")


def latest_values(history: DataFrame, instance_name: str | None = None) -> DataFrame:
    """Latest value per tag (optionally within one instance).

    The correlated ``timestamp = (SELECT MAX ...)`` becomes a single
    ``max_by`` hash aggregate: no join, partial aggregation per task. Ties on
    the latest timestamp resolve deterministically to the highest id.
    """
    rows = history_filter(history, instance_name=instance_name)
    return rows.groupBy("param_name").agg(
        F.max_by("param_value", time_id_key()).alias("param_value"),
        F.max("timestamp").alias("timestamp"),
    )


def tag_catalog(history: DataFrame) -> DataFrame:
    """First sighting of every tag with its initial value, instance and type."""
    # instance and type are functions of the tag: grouping keys, not first() over
    # strings (string buffers would force a sort aggregate)
    return history.groupBy("param_name", "instance_name", "param_type").agg(
        F.min("timestamp").alias("first_seen"),
        F.min_by("param_value", time_id_key()).alias("initial_value"),
        F.count(F.lit(1)).alias("records"),
    )


def distinct_timestamps(history: DataFrame) -> DataFrame:
    """A4: distinct timestamps, ascending."""
    return history.select("timestamp").distinct().orderBy("timestamp")


#: a page is looked for until at most so many rows precede it in the range that holds it
PAGE_SLACK = 10_000
#: microseconds of a day, hour, minute, second, millisecond, microsecond
_TIME_STEPS = (86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000, 1_000, 1)
_ID_STEPS = tuple(1 << b for b in (48, 36, 24, 12, 0))


def _bucket_counts(df: DataFrame, key: Column) -> list[tuple[int | None, int]]:
    rows = df.groupBy(key.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted(((r["b"], r["n"]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0))


def _lower_bound(df: DataFrame, value: Column, steps: tuple[int, ...], skip: int, slack: int, at_least) -> tuple[Column, int, int | None, bool]:
    """Refine the range that holds ordinal ``skip`` (nulls first) by histograms of ever finer ``steps``.

    Returns the condition of all rows from that range on, the rows of the range
    before the ordinal, its only value if it has one, and whether that still has
    more than ``slack`` rows before the ordinal.
    """
    inside, from_here, low = F.lit(True), F.lit(True), None
    for step in steps:
        for b, n in _bucket_counts(df.filter(inside), F.floor(value / F.lit(step)).cast("long")):
            if skip < n:
                break
            skip -= n
        if b is None:  # the ordinal lies among the rows without a value
            return value.isNull() | F.lit(True), skip, None, skip > slack
        low = b * step
        from_here = at_least(low)
        inside = at_least(low) & ~at_least(low + step)
        if skip <= slack:
            return from_here, skip, None, False
    return from_here, skip, low, True


def page_slice(df: DataFrame, start: int, n: int = 1000, order: tuple = ("timestamp", "id"), slack: int = PAGE_SLACK) -> DataFrame:
    """F8: ordinal rows ``[start, min(start+n, total))`` with start clamped to ``total - n``.

    Order statistics by histograms: rows are counted per day of the first order
    column (a timestamp; a few thousand counts for a decade), then per hour, minute,
    ... microsecond of the range that holds the first wanted ordinal, then by ranges
    of the second column if it is an integer, until at most ``slack`` rows of that
    range precede the page. What is left is a top-k of ``slack + n`` rows at most,
    however deep the page and however dense a day or an instant. Each round counts
    the range of the round before only. Nulls come first.
    """
    first = F.col(order[0])
    days = _bucket_counts(df, F.date_diff(F.to_date(first), F.lit(_dt.date(1970, 1, 1))).cast("long"))
    total = sum(c for _, c in days)
    start = max(0, min(int(start), total - n))
    # the last day that the page reaches, and the rows before the first one
    before = seen = 0
    opening = closing = None
    for d, c in days:
        if seen <= start < seen + c:
            opening, before = d, seen
        if seen < start + n:
            closing = d
        seen += c
    if not total:
        return df.limit(0)
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), first.cast("timestamp_ntz"))
    rows = df if closing is None else df.filter(first.isNull() | (first < _instant((closing + 1) * _TIME_STEPS[0])))
    rows = df.filter(first.isNull()) if closing is None else rows
    skip = start - before
    page = rows if opening is None else rows.filter(first >= _instant(opening * _TIME_STEPS[0]))
    dense, value = skip > slack and opening is None, None
    if opening is not None and skip > slack:
        day = rows.filter((first >= _instant(opening * _TIME_STEPS[0])) & (first < _instant((opening + 1) * _TIME_STEPS[0])))
        from_here, skip, value, dense = _lower_bound(day, micros, _TIME_STEPS[1:], skip, slack, lambda us: first >= _instant(us))
        page = rows.filter(from_here)
    if dense and len(order) > 1 and isinstance(df.schema[order[1]].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        # more than ``slack`` rows of one instant (or without a time) precede the page
        same = first.isNull() if value is None else first == _instant(value)
        second = F.col(order[1])
        from_here, skip, _, _ = _lower_bound(rows.filter(same), second, _ID_STEPS, skip, slack, lambda i: second >= F.lit(i))
        later = first.isNotNull() if value is None else first > _instant(value)
        page = rows.filter(later | (same & from_here))
    return page.orderBy(*order).offset(skip).limit(n)


def _instant(us: int) -> Column:
    """A zone-less timestamp literal from epoch microseconds."""
    return _lit_ts(_dt.datetime(1970, 1, 1) + _dt.timedelta(microseconds=us))


def select_tags(df: DataFrame, tags, time_column: str | None = None) -> DataFrame:
    """keep the time column and the requested tags that exist; unknown tags are ignored."""
    present = [t for t in tags if t in df.columns]
    cols = ([time_column] if time_column else []) + present
    return df.select(*[F.col(f"`{c}`") for c in cols])
