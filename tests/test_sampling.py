"""P1 greedy sampling against the sequential rule; both composition paths."""

import datetime as dt
import random

import pytest

from tagloom.operators import sampling as P
from tagloom.sources.history import events_history


def sequential(times, interval_s):
    kept, last = [], None
    for t in sorted(set(times)):
        if last is None or (t - last).total_seconds() >= interval_s:
            kept.append(t)
            last = t
    return kept


def _frame(spark, times):
    return spark.createDataFrame([(t,) for t in times], "timestamp timestamp_ntz")


@pytest.mark.parametrize("interval", [0.7, 5.0, 60.0, 3600.0])
def test_random_times_match_sequential(spark, interval):
    rnd = random.Random(int(interval * 10))
    base = dt.datetime(2024, 1, 1)
    times = [base + dt.timedelta(microseconds=rnd.randrange(0, 6 * 3600 * 10**6)) for _ in range(3000)]
    times += times[:300]  # duplicates: distinct timestamps only
    kept = P.greedy_kept_timestamps(_frame(spark, times), interval).collect()
    assert sorted(r.timestamp for r in kept) == sequential(times, interval)


def test_distributed_composition_matches(spark):
    rnd = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    times = [base + dt.timedelta(seconds=rnd.randrange(0, 50000)) for _ in range(2000)]
    kept = P.greedy_kept_timestamps(_frame(spark, times), 30.0).collect()
    assert sorted(r.timestamp for r in kept) == sequential(times, 30.0)


def test_bursty_times(spark):
    # one burst holds a third of all timestamps; sparse elsewhere
    base = dt.datetime(2024, 1, 1)
    times = [base + dt.timedelta(milliseconds=i) for i in range(1500)]
    times += [base + dt.timedelta(seconds=10 + 3 * i) for i in range(3000)]
    kept = P.greedy_kept_timestamps(_frame(spark, times), 0.25).collect()
    assert sorted(r.timestamp for r in kept) == sequential(times, 0.25)


def test_events_query_sampled_rows(spark):
    h = events_history(spark, "/root/testdata/sf0.001")
    rows = h.collect()
    kept = set(sequential([r.timestamp for r in rows], 3600.0))
    expect = sorted([r for r in rows if r.timestamp in kept], key=lambda r: (r.timestamp, r.id), reverse=True)[:1000]
    got = P.query_sampled(h, sample_interval=3600.0, limit=1000).collect()
    assert [r.id for r in got] == [r.id for r in expect]


def test_passthrough_when_interval_missing(spark):
    h = events_history(spark, "/root/testdata/sf0.001")
    a = P.query_sampled(h, sample_interval=None, limit=20).collect()
    b = P.query_sampled(h, sample_interval=-1, limit=20).collect()
    assert [r.id for r in a] == [r.id for r in b] and len(a) == 20


def test_empty_input(spark):
    kept = P.greedy_kept_timestamps(_frame(spark, []), 1.0).collect()
    assert kept == []


def test_sample_flag_rules(spark):
    df = spark.range(1, 31).withColumnRenamed("id", "c")
    assert df.filter(P.sample_flag("c", 0.5, 5.0)).count() == 3
    assert df.filter(P.sample_flag("c", 0.1, 0.3)).count() == 15  # int(0.3 / 0.1) == 2: every 2nd cycle
    assert df.filter(P.sample_flag("c", 0.5, None)).count() == 30
    with pytest.raises(ValueError):
        P.sample_flag("c", 0.5, 0.2)
    with pytest.raises(ValueError):
        P.sample_flag("c", 0.0, None)


def test_result_survives_cache_clear(spark):
    h = events_history(spark, "/root/testdata/sf0.001")
    q = P.query_sampled(h, sample_interval=1800.0, limit=None)
    spark.catalog.clearCache()  # the returned plan must not depend on a cached layout
    kept = set(sequential([r.timestamp for r in h.collect()], 1800.0))
    assert {r.timestamp for r in q.collect()} == kept
