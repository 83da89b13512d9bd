"""Stored JSON, batch logs, settlement, registry, targets and the recent log."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from snapfold import schemas
from snapfold.functions.zones import zones
from snapfold.operators.registry import checked_feeds, registry_problems
from snapfold.operators.settle import (
    backoff_ms,
    longest_retry_after,
    operation_results,
    settle,
    settling_attempts,
)
from snapfold.operators.targets import resolve_targets
from snapfold.sources.batchlog import read_responses
from snapfold.sources.recent import page_size, recent, recent_page, revive_recent, write_recent
from snapfold.sources.snapshots import warn_content_type
from snapfold.sources.state import revive_state
from snapfold.workloads import QUERIES, records

REQUESTS = "run_seq bigint, feed_id string, batch_id bigint, id string, uid string, kind string"


def blob(**changes):
    good = {"eventId": "e", "hash": "h", "start": "2026-01-01T00:00:00.000Z"}
    base = {"version": 1, "calendarId": "c", "lastSyncAt": "2026-01-01T00:00:00.000Z", "events": {"a": good}}
    return json.dumps({**base, **changes})


def test_state_round_trip_and_faults(spark):
    good = {"eventId": "e", "hash": "h", "start": "2026-01-01T00:00:00.000Z"}
    entries = {
        "ok": good,
        "constructor": good,
        "no id": {"hash": "h", "start": good["start"]},
        "number": {**good, "eventId": 5},
        "blank": {**good, "hash": ""},
        "start": {**good, "start": "nonsense"},
        "text": json.dumps(good),
        "list": [good],
        "null": None,
        "": good,
    }
    raw = spark.createDataFrame(
        [
            ("mixed", blob(events=entries)),
            ("fine", blob()),
            ("v99", blob(version=99)),
            ("v text", blob(version="1")),
            ("junk", "{not json"),
            ("list", "[1]"),
            ("none", None),
            ("no events", blob(events=[1], calendarId=7, lastSyncAt="never")),
        ],
        "feed_id string, json string",
    )
    state, headers, dropped = revive_state(raw)
    assert sorted((r.feed_id, r.uid) for r in state.collect()) == [
        ("fine", "a"),
        ("mixed", "constructor"),
        ("mixed", "ok"),
    ]
    assert {r.feed_id: r.dropped for r in dropped.collect()} == {"fine": 0, "mixed": 8}
    heads = {r.feed_id: r for r in headers.collect()}
    assert {f for f, r in heads.items() if r.was_reset} == {"v99", "v text", "junk", "list", "none"}
    epoch = dt.datetime(1970, 1, 1)
    assert (heads["no events"].calendar_id, heads["no events"].last_sync_at) == (None, epoch)
    assert (heads["fine"].calendar_id, heads["fine"].last_sync_at) == ("c", dt.datetime(2026, 1, 1))
    assert (heads["v99"].calendar_id, heads["v99"].last_sync_at) == (None, epoch)


def test_recent_revive(spark):
    good = {"uid": "u", "summary": "s", "start": "t", "addedAt": "a", "eventId": "e"}
    logs = [
        {"version": 1, "entries": [good, {**good, "uid": 5}, "x", {**good, "feedId": "f"}, {**good, "feedId": 1}]},
        {"version": 2, "entries": [good]},
        {"version": 1, "entries": {"0": good}},
        [good],
    ]
    raw = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(logs)], "log int, json string")
    got = sorted((r.log, r.ord, r.uid, r.feed_id) for r in revive_recent(raw).collect())
    assert got == [(0, 0, "u", "unknown"), (0, 3, "u", "f"), (0, 4, "u", "unknown")]


def log_of(spark, *runs):
    rows = [
        (seq, "f", f"u{seq}-{i}", "s", start, "a", "e", i)
        for seq, starts in enumerate(runs)
        for i, start in enumerate(starts)
    ]
    return spark.createDataFrame(rows, schemas.RECENT)


def test_recent_view(spark, folder):
    log = log_of(spark, ["2026-01-05", "2026-01-09", "2026-01-05"], ["2026-01-01"])
    assert [r.uid for r in recent(log, 10).collect()] == ["u1-0", "u0-1", "u0-0", "u0-2"]
    assert len(recent(log_of(spark, ["x"] * 150), 100).collect()) == 100
    assert recent(log_of(spark, ["x"] * 3), 0).count() == 1
    assert recent(log_of(spark, ["x"] * 1200), 5000).count() == 1200
    page = recent_page(log, "2", configured=3).collect()
    assert [(r.uid, r["count"]) for r in page] == [("u1-0", 3), ("u0-1", 3)]
    sizes = {None: 7, "5": 5, "0": 100, "-1": 100, "junk": 100, "1e4": 10000, "2.9": 2, "": 100}
    assert {k: page_size(k, 7) for k in sizes} == sizes
    write_recent(log.drop("run_seq"), folder + "/recent", 3)
    assert spark.read.parquet(folder + "/recent").count() == 4
    write_recent(log.drop("run_seq").limit(0), folder + "/recent", 3)
    assert spark.read.schema(schemas.RECENT).parquet(folder + "/recent").count() == 0


def test_responses(spark):
    reply = {
        "responses": [
            {"id": "op-1", "status": 201, "body": {"id": "x"}},
            {"id": "op-2", "status": 429, "headers": {"Retry-After": "7", "retry-after": "99"}},
            {"id": "op-3", "status": 204, "body": None},
            {"id": 5, "status": 200},
            {"id": "op-4", "status": "200"},
            "text",
            None,
        ]
    }
    raw = spark.createDataFrame(
        [(1, json.dumps(reply)), (2, "[]"), (3, "{}"), (4, "junk")], "batch_id bigint, json string"
    )
    got = {r.id: (r.batch_id, r.status, r.body, r.retry_after) for r in read_responses(raw).collect()}
    assert got == {
        "op-1": (1, 201, '{"id":"x"}', None),
        "op-2": (1, 429, None, "7"),
        "op-3": (1, 204, None, None),
    }


def test_settlement(spark):
    kinds = ["create", "create", "update", "delete", "create", "update", "delete", "create"]
    requests = spark.createDataFrame(
        [(1, "f", 0, f"op-{i}", f"u{i}", k) for i, k in enumerate(kinds)], REQUESTS
    )
    log = [
        # (attempt, id, status, body, retry_after), in no order
        (2, "op-1", 201, '{"id":"new1"}', None),
        (1, "op-1", 429, None, "3"),
        (1, "op-0", 201, '{"id":"new0"}', None),
        (1, "op-2", 503, None, "soon"),
        (2, "op-2", 429, None, "9"),
        (3, "op-2", 504, '{"error":{"message":"slow"}}', "11"),
        (2, "op-3", 204, None, None),
        (1, "op-4", 201, "{}", None),
        (1, "op-5", 404, None, None),
        (2, "op-5", 200, None, None),
        (4, "op-6", 204, None, None),
        (1, "op-7", 400, '{"error":{"code":"x","message":"bad"}}', None),
        (2, "op-7", 429, None, "50"),
        (1, "op-99", 201, '{"id":"stray"}', None),
    ]
    responses = spark.createDataFrame(
        [(1, "f", 0, a, i, s, b, r) for a, i, s, b, r in log], schemas.RESPONSES
    )
    answers = settle(requests, responses)
    got = {r.uid: (r.ok, r.status, r.event_id, r.error) for r in operation_results(answers).collect()}
    assert got == {
        "u0": (True, 201, "new0", None),
        "u1": (True, 201, "new1", None),
        "u2": (False, 504, None, "slow"),
        "u3": (True, 204, None, None),
        "u4": (False, 502, None, None),
        "u5": (False, 404, None, None),
        "u6": (False, 503, None, None),
        "u7": (False, 400, None, "bad"),
    }
    waits = longest_retry_after(responses, settling_attempts(responses)).collect()
    assert {r.attempt: (r.sent_again, r.retry_after_s) for r in waits} == {1: (2, 3.0), 2: (1, 9.0)}


def test_backoff(spark):
    now = dt.datetime(2026, 7, 27, 12)
    cases = [
        (1, "3", 3000),
        (1, "600", 20000),
        (1, None, 500),
        (3, None, 2000),
        (9, "", 20000),
        (1, "Mon, 27 Jul 2026 12:00:05 GMT", 5000),
        (1, "Mon, 27 Jul 2026 11:00:00 GMT", 0),
        (2, "soon", 1000),
    ]
    df = spark.createDataFrame([(a, r) for a, r, _ in cases], "a int, r string").coalesce(1)
    got = [r[0] for r in df.select(backoff_ms(F.col("a"), F.col("r"), F.lit(now))).collect()]
    assert got == [want for _, _, want in cases]


def feed_row(**changes):
    base = {
        "feed_id": None,
        "ics_url": "https://x.invalid/a",
        "target_upn": "me@x.org",
        "calendar_name": None,
        "event_category": " ",
        "default_duration_minutes": None,
        "display_tz": None,
        "state_retention_days": "",
        "recent_limit": None,
    }
    return tuple({**base, **changes}.values())


RULES = [
    ({}, []),
    ({"ics_url": None}, ["ics_url"]),
    ({"ics_url": "http://x.invalid"}, ["ics_url"]),
    ({"ics_url": "nonsense"}, ["ics_url"]),
    ({"target_upn": "not-a-upn"}, ["target_upn"]),
    ({"target_upn": " "}, ["target_upn"]),
    ({"display_tz": "Mars/Olympus"}, ["display_tz"]),
    ({"display_tz": "europe/oslo"}, []),
    ({"feed_id": "has spaces/and-slashes"}, ["feed_id"]),
    ({"feed_id": "x" * 65}, ["feed_id"]),
    ({"feed_id": " My-Feed_1 "}, []),
    ({"default_duration_minutes": "soon"}, ["default_duration_minutes"]),
    ({"state_retention_days": "-5"}, ["state_retention_days"]),
    ({"recent_limit": "1.5"}, ["recent_limit"]),
    ({"recent_limit": "0"}, ["recent_limit"]),
    ({"recent_limit": "2e2"}, []),
    (
        {"ics_url": "", "target_upn": "x", "display_tz": "no", "feed_id": "-", "recent_limit": "x"},
        ["ics_url", "target_upn", "display_tz", "feed_id", "recent_limit"],
    ),
]


def test_registry(spark):
    raw = spark.createDataFrame([feed_row(**c) for c, _ in RULES], schemas.RAW_FEEDS).coalesce(1)
    raw = raw.withColumn("i", F.monotonically_increasing_id())
    got = {r.i: r.problems for r in registry_problems(raw, zones(spark)).collect()}
    assert [[p.split(":")[0] for p in got[i]] for i in range(len(RULES))] == [want for _, want in RULES]
    for i, (changes, _) in enumerate(RULES):
        assert not any(str(v) in p for v in changes.values() if v and len(v) > 4 for p in got[i])
    feeds = {r.feed_id: r for r in checked_feeds(raw.drop("i").dropDuplicates(), zones(spark)).collect()}
    assert set(feeds) == {"default", "my-feed_1"}
    row = feeds["my-feed_1"]
    assert (row.calendar_name, row.event_category, row.display_tz) == ("TV", "TV", "UTC")
    assert (row.default_duration_minutes, row.state_retention_days, row.recent_limit) == (30, 30, 100)


def test_targets(spark):
    feeds = spark.createDataFrame(
        [(f, "me", "TV") for f in ("kept", "dead", "new", "twice")] + [("none", "you", "TV")],
        "feed_id string, target_upn string, calendar_name string",
    )
    stored = spark.createDataFrame(
        [("kept", "c9"), ("dead", "gone"), ("twice", "your"), ("none", "c9")], "feed_id string, calendar_id string"
    )
    catalogue = spark.createDataFrame(
        [("me", "c9", "Old", 0), ("me", "c2", "TV", 2), ("me", "c1", "TV", 1), ("you", "your", "tv", 0)],
        schemas.TARGETS,
    )
    got = {r.feed_id: (r.calendar_id, r.resolution) for r in resolve_targets(feeds, stored, catalogue).collect()}
    assert got == {
        "kept": ("c9", "known"),
        "dead": ("c1", "matched"),
        "new": ("c1", "matched"),
        "twice": ("c1", "matched"),
        "none": (None, "missing"),
    }


@pytest.mark.parametrize(
    "given, warn",
    [("text/calendar; charset=utf-8", False), ("TEXT/PLAIN", False), ("text/html", True), ("", False), (None, False)],
)
def test_content_type(spark, given, warn):
    assert spark.range(1).select(warn_content_type(F.lit(given).cast("string"))).first()[0] is warn


def test_two_runs_read_landed_documents(spark, folder, monkeypatch):
    """A run reads its documents several times; rendering them from the events is not part of that."""
    rows = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    days = [dt.datetime(2024, 1, day) for day in (3, 12, 20)]
    events = [(i, day, i % 2, ("view", "click")[i % 2], 60.0, f'{{"k": {i}}}') for i, day in enumerate(days * 2)]
    spark.createDataFrame(events, rows).write.parquet(f"{folder}/events.parquet")
    given = []
    monkeypatch.setattr(records, "run", lambda spark, store, run_seq, now, documents, feeds, *_: given.append((store, documents, feeds)))
    QUERIES["two_runs"](spark, folder)
    assert len(given) == 2
    for store, documents, feeds in given:
        assert store.buckets == int(spark.conf.get("spark.sql.shuffle.partitions"))
        for frame, n in ((documents, 2), (feeds, 2)):
            assert frame.count() == n
            plan = frame._jdf.queryExecution().optimizedPlan().toString()
            assert all(step not in plan for step in ("Aggregate", "Join", "Window")), plan
