"""Whole runs over landed documents, with an applier that answers as a calendar service would."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

import snapfold.plans.run as run_module
from snapfold import schemas
from snapfold.operators.fold import feed_status
from snapfold.plans.run import (
    Store,
    adopt,
    commits,
    current_state,
    feed_additions,
    read_feed_state,
    recent_additions,
    run,
)
from snapfold.sources.recent import write_recent
from snapfold.sources.snapshots import read_snapshots, silent_feeds
from snapfold.streaming.landing import _run_of, start_stream

NOW = dt.datetime(2026, 7, 27, 12)


def ics(*events):
    """events: (uid, title, start as basic UTC text)"""
    blocks = [
        f"BEGIN:VEVENT\r\nUID:{u}\r\nSUMMARY:{t}\r\nDTSTART:{s}\r\nEND:VEVENT\r\n" for u, t, s in events
    ]
    return "BEGIN:VCALENDAR\r\n" + "".join(blocks) + "END:VCALENDAR\r\n"


SHOWS = [
    ("ep-1", "First", "20260801T210000Z"),
    ("ep-2", "Second", "20260802T210000Z"),
    ("ep-3", "Third", "20260720T210000Z"),
]


def answer(requests, status=None):
    """Success on the first attempt; ``status`` may map the request kind to another one."""
    ok = F.when(F.col("kind") == "create", 201).when(F.col("kind") == "update", 200).otherwise(204)
    status = ok if status is None else F.coalesce(status, ok)
    return requests.select(
        "run_seq",
        "feed_id",
        "batch_id",
        F.lit(1).alias("attempt"),
        "id",
        status.alias("status"),
        F.when(
            F.col("kind") == "create", F.to_json(F.struct(F.concat(F.lit("id-"), "uid").alias("id")))
        ).alias("body"),
        F.lit(None).cast("string").alias("retry_after"),
    )


class Harness:
    def __init__(self, spark, folder, feeds=("f",)):
        self.spark, self.folder = spark, folder
        self.store = Store(folder + "/store", buckets=4)
        self.landing = folder + "/landing"
        self.feeds = spark.createDataFrame(
            [(f, "https://x.invalid/a", "me@x.invalid", "TV", "TV", 30, "Europe/Oslo", 30, 100) for f in feeds],
            schemas.FEEDS,
        )
        self.targets = spark.createDataFrame([("me@x.invalid", "cal-1", "TV", 0)], schemas.TARGETS)
        self.sent = []
        self.seq = 0

    def land(self, text, feed="f", part="part-0-of-1"):
        self.seq += 1
        folder = f"{self.landing}/feed_id={feed}/snapshot_seq={self.seq}"
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{part}.ics", "w", newline="") as out:
            out.write(text)

    def go(self, now=NOW, status=None, applier=None):
        def recording(requests):
            self.sent = requests.orderBy("feed_id", "op_ord").collect()
            return answer(requests, status)

        run_seq = len(commits(self.spark, self.store))
        self.sent = []
        docs = read_snapshots(self.spark, self.landing)
        rows = run(
            self.spark, self.store, run_seq, now, docs, self.feeds, self.targets, applier or recording
        ).collect()
        keys = ("created", "updated", "deleted", "skipped", "pruned", "errors", "aborted")
        return {r.feed_id: tuple(r[k] for k in keys) for r in rows}

    def state(self, feed="f"):
        rows = current_state(self.spark, self.store).where(F.col("feed_id") == feed).collect()
        return {r.uid: r for r in rows}


def test_life_of_a_feed(spark, folder):
    h = Harness(spark, folder)
    h.land(ics(*SHOWS))
    assert h.go() == {"f": (3, 0, 0, 0, 0, 0, None)}
    assert [(r.kind, r.method, r.url, r.id) for r in h.sent] == [
        ("create", "POST", "/users/me%40x.invalid/calendars/cal-1/events", f"op-{i}") for i in range(3)
    ]
    assert set(h.state()) == {"ep-1", "ep-2", "ep-3"}
    assert h.state()["ep-1"].start == "2026-08-01T21:00:00.000Z"

    h.land(ics(*SHOWS))
    assert h.go() == {"f": (0, 0, 0, 3, 0, 0, None)}
    assert h.sent == []

    h.land(ics(("ep-1", "First", "20260801T223000Z"), *SHOWS[1:]))
    assert h.go() == {"f": (0, 1, 0, 2, 0, 0, None)}
    assert [(r.kind, r.method, r.url) for r in h.sent] == [
        ("update", "PATCH", "/users/me%40x.invalid/events/id-ep-1")
    ]
    assert "transactionId" not in h.sent[0].body
    assert h.state()["ep-1"].start == "2026-08-01T22:30:00.000Z"

    # A future event that leaves is deleted, one that has aired stays.
    h.land(ics(("ep-1", "First", "20260801T223000Z")))
    assert h.go() == {"f": (0, 0, 1, 1, 0, 0, None)}
    assert [(r.kind, r.method, r.url) for r in h.sent] == [
        ("delete", "DELETE", "/users/me%40x.invalid/events/id-ep-2")
    ]
    assert set(h.state()) == {"ep-1", "ep-3"}

    # Past the retention it is forgotten without an operation.
    h.land(ics(("ep-1", "First", "20260801T223000Z")))
    assert h.go(now=dt.datetime(2026, 9, 1)) == {"f": (0, 0, 0, 1, 1, 0, None)}
    assert h.sent == [] and set(h.state()) == {"ep-1"}

    log = recent_additions(spark, h.store, 10).collect()
    assert [r.uid for r in log] == ["ep-2", "ep-1", "ep-3"]
    last = commits(spark, h.store)[0].feed_state_run_seq
    status = feed_status(
        current_state(spark, h.store), read_feed_state(spark, h.store, last), h.feeds
    ).collect()
    assert [tuple(r) for r in status] == [("f", "TV", True, 1, "2026-09-01T00:00:00.000Z")]


@pytest.mark.parametrize(
    "text, reason",
    [
        ("BEGIN:VCALENDAR\r\nEND:VCALENDAR\r\n", "ics-feed-empty"),
        ("   \r\n  ", "ics-feed-empty"),
        (ics(("ep-1", "x", "soon")), "ics-parse-failed"),
    ],
)
def test_unusable_snapshot_changes_nothing(spark, folder, text, reason):
    h = Harness(spark, folder, feeds=("f", "g"))
    h.land(ics(*SHOWS))
    h.land(ics(*SHOWS), feed="g")
    assert h.go() == {f: (3, 0, 0, 0, 0, 0, None) for f in "fg"}
    before = h.state()
    h.land(text)
    h.land(ics(SHOWS[0]), feed="g")
    assert h.go() == {"f": (0, 0, 0, 0, 0, 1, reason), "g": (0, 0, 1, 1, 0, 0, None)}
    assert {r.feed_id for r in h.sent} == {"g"}
    assert h.state() == before and set(h.state("g")) == {"ep-1", "ep-3"}


def test_missing_part_is_a_failed_fetch(spark, folder):
    h = Harness(spark, folder)
    h.land(ics(*SHOWS))
    h.go()
    h.land(ics(SHOWS[0]), part="part-0-of-2")
    assert h.go() == {"f": (0, 0, 0, 0, 0, 1, "ics-fetch-failed")}
    assert len(h.state()) == 3


def test_unresolved_target_and_unregistered_feed(spark, folder):
    h = Harness(spark, folder)
    h.targets = h.targets.withColumn("name", F.lit("Other"))
    h.land(ics(*SHOWS))
    h.land(ics(*SHOWS), feed="stranger")
    assert h.go() == {"f": (0, 0, 0, 0, 0, 1, "calendar-resolve-failed")}
    assert h.sent == [] and h.state() == {}


def test_failures_are_retried_by_the_next_run(spark, folder):
    h = Harness(spark, folder)
    h.land(ics(*SHOWS))
    broken = F.when(F.col("uid") == "ep-2", 500)
    assert h.go(status=broken) == {"f": (2, 0, 0, 0, 0, 1, None)}
    h.land(ics(*SHOWS))
    assert h.go() == {"f": (1, 0, 0, 2, 0, 0, None)}
    assert [r.uid for r in h.sent] == ["ep-2"]


def test_apply_failure_saves_nothing(spark, folder):
    h = Harness(spark, folder, feeds=("f", "g"))
    h.land(ics(SHOWS[0]), feed="g")
    h.go()

    def down(requests):
        raise ConnectionError("no answer")

    h.land(ics(*SHOWS))
    h.land(ics(SHOWS[0]), feed="g")
    out = h.go(applier=down)
    assert out == {"f": (0, 0, 0, 0, 0, 1, "apply-failed"), "g": (0, 0, 0, 1, 0, 0, None)}
    assert h.state() == {} and set(h.state("g")) == {"ep-1"}
    assert h.go() == {"f": (3, 0, 0, 0, 0, 0, None)}


def test_number_of_buckets_may_change(spark, folder):
    h = Harness(spark, folder)
    h.land(ics(*SHOWS))
    h.go()
    h.store = Store(h.store.root, buckets=3)
    h.land("\n")
    assert h.go() == {"f": (0, 0, 0, 0, 0, 1, "ics-feed-empty")}
    assert len(h.state()) == 3
    h.land(ics(*SHOWS))
    assert h.go() == {"f": (0, 0, 0, 3, 0, 0, None)}
    assert commits(spark, h.store)[0].buckets == 3 and len(h.state()) == 3


def test_repeated_run_is_left_alone(spark, folder):
    h = Harness(spark, folder)
    h.land(ics(*SHOWS))
    h.go()
    docs = read_snapshots(spark, h.landing)
    calls = []
    run(spark, h.store, 0, NOW, docs, h.feeds, h.targets, lambda r: calls.append(r))
    assert calls == []


def test_larger_run_and_no_op(spark, folder):
    h = Harness(spark, folder)
    many = [(f"ep-{i:03}", f"Show {i}", "20260801T210000Z") for i in range(200)]
    h.land(ics(*many))
    assert h.go() == {"f": (200, 0, 0, 0, 0, 0, None)}
    assert sorted({r.batch_id for r in h.sent}) == list(range(10))
    h.land(ics(*many))
    assert h.go() == {"f": (0, 0, 0, 200, 0, 0, None)}


def test_stream_runs_once_per_batch_and_takes_the_newest(spark, folder):
    h = Harness(spark, folder)
    sizes = []

    def applier(requests):
        sizes.append(requests.count())
        return answer(requests)

    def turn():
        query = start_stream(
            spark, h.store, h.landing, lambda: (h.feeds, h.targets), applier, lambda: NOW
        )
        query.awaitTermination()

    h.land(ics(*SHOWS))
    h.land(ics(*SHOWS[:2]))
    turn()
    assert sizes == [2] and set(h.state()) == {"ep-1", "ep-2"}
    h.land(ics(*SHOWS))
    turn()
    assert sizes == [2, 1] and len(h.state()) == 3
    turn()
    assert sizes == [2, 1] and len(commits(spark, h.store)) == 2
    # A poll that is older than the applied one is ignored.
    h.seq = -1
    h.land(ics(SHOWS[0]))
    turn()
    assert sizes == [2, 1] and len(h.state()) == 3


def turns_of(spark, h, clocks, checkpoint="stream"):
    """Run the stream once, recording the times that runs are given."""

    def clock():
        clocks.append(NOW + dt.timedelta(days=len(clocks)))
        return clocks[-1]

    start_stream(spark, h.store, h.landing, lambda: (h.feeds, h.targets), answer, clock).awaitTermination()


def test_parts_of_a_snapshot_may_land_in_two_batches(spark, folder):
    h, clocks = Harness(spark, folder), []
    h.land(ics(*SHOWS[:2]), part="part-0-of-2")
    turns_of(spark, h, clocks)
    assert not h.state()
    h.seq -= 1
    h.land(ics(SHOWS[2]), part="part-1-of-2")
    turns_of(spark, h, clocks)
    assert set(h.state()) == {"ep-1", "ep-2", "ep-3"}


def test_a_new_checkpoint_goes_on_with_new_runs(spark, folder):
    h, clocks = Harness(spark, folder), []
    h.land(ics(*SHOWS[:2]))
    turns_of(spark, h, clocks)
    before = commits(spark, h.store)[0].run_seq
    os.rename(h.store.folder("stream"), h.store.folder("stream-before"))
    h.land(ics(*SHOWS))
    turns_of(spark, h, clocks)
    assert len(h.state()) == 3 and commits(spark, h.store)[0].run_seq > before


def test_a_repeated_batch_keeps_its_number_and_clock(spark, folder):
    store = Store(folder + "/store")
    first = _run_of(spark, store, "s/0", lambda: NOW)
    assert first == (0, NOW) == _run_of(spark, store, "s/0", lambda: NOW + dt.timedelta(days=9))


def test_recent_additions_of_uncommitted_runs_do_not_show(spark, folder):
    h = Harness(spark, folder)
    h.land(ics(*SHOWS[:1]))
    h.go()
    row = spark.read.parquet(h.store.folder("recent")).drop("run_seq")
    write_recent(row, h.store.folder("recent"), 99)
    assert [r.run_seq for r in recent_additions(spark, h.store, 5000).collect()] == [commits(spark, h.store)[0].run_seq]


def test_a_feed_that_stopped_landing_is_reported(spark, folder):
    h = Harness(spark, folder, ("f", "never", "old"))
    h.land(ics(*SHOWS), feed="old")
    h.go()
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) + dt.timedelta(days=2)
    old = f"{h.landing}/feed_id=old/snapshot_seq=1/part-0-of-1.ics"
    os.utime(old, (os.path.getmtime(old) - 86400 * 9,) * 2)
    h.land(ics(*SHOWS))
    landed = read_snapshots(spark, h.landing)
    silent = silent_feeds(landed, h.feeds, now, dt.timedelta(days=5))
    assert {r.feed_id for r in silent.collect()} == {"never", "old"}
    rows = run(spark, h.store, 1, NOW, landed, h.feeds, h.targets, answer, silent=silent).collect()
    assert {r.feed_id: (r.created, r.errors, r.aborted) for r in rows} == {
        "f": (3, 0, None),
        "never": (0, 1, "ics-fetch-failed"),
        "old": (0, 1, "ics-fetch-failed"),
    }
    assert len(h.state("old")) == 3


def test_stored_json_is_adopted_and_nothing_is_created_again(spark, folder):
    h = Harness(spark, folder)
    h.land(ics(*SHOWS))
    h.go()
    entries = {
        u: {"eventId": r.event_id, "hash": r.hash, "start": r.start} for u, r in h.state().items()
    }
    text = json.dumps(
        {"version": 1, "calendarId": "cal-1", "lastSyncAt": "2026-07-01T00:00:00.000Z", "events": {**entries, "x": {}}}
    )
    blobs = spark.createDataFrame([("f", text), ("g", "no json")], "feed_id string, json string")
    h.store = Store(folder + "/second", buckets=4)
    report = {r.feed_id: (r.was_reset, r.dropped) for r in adopt(spark, h.store, blobs).collect()}
    assert report == {"f": (False, 1), "g": (True, 0)}
    assert set(h.state()) == set(entries)
    assert h.go() == {"f": (0, 0, 0, 3, 0, 0, None)} and h.sent == []
    with pytest.raises(ValueError):
        adopt(spark, h.store, blobs)


def test_recent_limit_of_each_feed(spark, folder):
    h = Harness(spark, folder, ("f", "g"))
    for feed in ("f", "g"):
        h.land(ics(*SHOWS), feed=feed)
    h.go()
    h.land(ics(*SHOWS, ("ep-4", "Fourth", "20260728T210000Z")))
    h.go()
    limits = F.when(F.col("feed_id") == "f", 2).otherwise(0).cast("bigint")
    rows = feed_additions(spark, h.store, h.feeds.withColumn("recent_limit", limits)).collect()
    assert sorted((r.feed_id, r.uid) for r in rows) == [("f", "ep-2"), ("f", "ep-4"), ("g", "ep-2")]
    assert len(feed_additions(spark, h.store, h.feeds).collect()) == 7
    assert feed_additions(spark, Store(folder + "/none"), h.feeds).collect() == []


def test_an_answer_to_no_request_is_an_error(spark, folder):
    h = Harness(spark, folder)
    h.land(ics(*SHOWS))

    def applier(requests):
        made = answer(requests)
        return made.unionByName(made.limit(1).withColumn("id", F.lit("nobody")))

    assert h.go(applier=applier) == {"f": (3, 0, 0, 0, 0, 1, None)}
    assert set(h.state()) == {"ep-1", "ep-2", "ep-3"}


def test_a_state_that_could_not_be_written_is_an_error_of_each_feed(spark, folder, monkeypatch):
    h = Harness(spark, folder)
    h.land(ics(*SHOWS[:1]))
    assert h.go() == {"f": (1, 0, 0, 0, 0, 0, None)}
    h.land(ics(*SHOWS))

    def full(*_):
        raise OSError("no space")

    with monkeypatch.context() as m:
        m.setattr(run_module, "_advance", full)
        assert h.go() == {"f": (2, 0, 0, 1, 0, 1, None)}
    assert set(h.state()) == {"ep-1"} and len(commits(spark, h.store)) == 2
    assert h.go() == {"f": (2, 0, 0, 1, 0, 0, None)} and len(h.state()) == 3
