"""Settings that pass the rules but are longer than all time: they cost no feed its run."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from snapfold import schemas
from snapfold.functions.dates import LAST_US, duration_ms, event_end
from snapfold.functions.zones import zones
from snapfold.operators.reconcile import reconcile
from snapfold.operators.registry import checked_feeds
from snapfold.operators.replay import replay

NOW = dt.datetime(2026, 7, 27, 12)
ABSURD = [3_000_000_000, 9_000_000_000_000_000_000]


@pytest.mark.parametrize("days", ABSURD)
def test_retention_is_never_over_and_others_are_pruned(spark, days):
    events = spark.createDataFrame([], schemas.EVENTS).drop("snapshot_seq")
    old, odd = "1999-01-01T00:00:00.000Z", "no time"
    state = spark.createDataFrame([(f, u, "id", "h", s) for f in "ab" for u, s in (("x", old), ("y", odd))], schemas.STATE)
    runs = spark.createDataFrame([("a", NOW, days), ("b", NOW, 30)], "feed_id string, now timestamp, state_retention_days bigint")
    got = {(r.feed_id, r.uid): r.action for r in reconcile(events, state, runs).collect()}
    assert got == {("a", "x"): "retain", ("a", "y"): "prune", ("b", "x"): "prune", ("b", "y"): "prune"}


@pytest.mark.parametrize("days", ABSURD)
def test_replay_takes_them(spark, days):
    seen = spark.createDataFrame(
        [(f, 0, "u", "h", dt.datetime(2026, 1, 1)) for f in "ab"], "feed_id string, snapshot_seq bigint, uid string, hash string, start timestamp"
    )
    polls = [(f, k, NOW + dt.timedelta(days=40 * k), days if f == "a" else 30) for f in "ab" for k in range(3)]
    line = spark.createDataFrame(polls, "feed_id string, snapshot_seq bigint, now timestamp, state_retention_days bigint")
    got = sorted((r.feed_id, r.snapshot_seq, r.action) for r in replay(seen, line).collect())
    assert got == [("a", 0, "create"), ("b", 0, "create"), ("b", 1, "prune")]


def test_an_event_ends_with_the_year_9999_at_the_latest(spark):
    rows = [(NOW, None, m) for m in (30, 400_000_000_000, 9_000_000_000_000_000_000)]
    rows += [(NOW, d, 30) for d in ("PT1H", "P99999999W", "P" + "9" * 40 + "D", "-P" + "9" * 40 + "D")] + [(None, "PT1H", 30)]
    frame = spark.createDataFrame(rows, "start timestamp, duration string, minutes bigint")
    end = event_end(F.col("start"), F.lit(False), F.lit(None).cast("timestamp"), duration_ms(F.col("duration")), F.col("minutes"))
    base = int((NOW - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    got = [r.us for r in frame.select(F.unix_micros(end).alias("us")).collect()]
    half, hour = base + 1_800_000_000, base + 3_600_000_000
    assert got == [half, LAST_US, LAST_US, hour, LAST_US, LAST_US, half, None]


def test_the_registry_accepts_them(spark):
    raw = [("f", "https://x.invalid/a", "me@x.invalid", "TV", "TV", "4e11", "UTC", "3000000000", "1e30")]
    row = checked_feeds(spark.createDataFrame(raw, schemas.RAW_FEEDS), zones(spark)).first()
    assert (row.default_duration_minutes, row.state_retention_days, row.recent_limit) == (400_000_000_000, 3_000_000_000, 9_000_000_000_000_000_000)
