"""State out as JSON and in again, and a store that begins with a stored log."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from snapfold import schemas
from snapfold.plans.run import Store, adopt, current_state, export_states, feed_additions, recent_additions
from snapfold.sources.export import read_states, state_parts
from snapfold.sources.state import revive_state
from test_run import SHOWS, Harness, ics


def test_export_and_revive_are_the_identity(spark):
    rnd = random.Random(1)
    signs = ['"', "\\", "\n", "é", "\U0001f600", "a", "{", "}", ",", " ", " ", "/"]
    rows = {}
    for feed in "abc":
        for _ in range({"a": 300, "b": 1, "c": 7}[feed]):
            uid = "".join(rnd.choice(signs) for _ in range(rnd.randrange(1, 9)))
            rows[feed, uid] = ("id" + rnd.choice(signs), "h", f"2026-01-{rnd.randrange(1, 28):02}T00:00:00.000Z")
    state = spark.createDataFrame([(*k, *v) for k, v in rows.items()], schemas.STATE)
    synced = dt.datetime(2026, 7, 27, 12)
    headers = spark.createDataFrame([("a", "cal", synced), ("d", None, synced)], "feed_id string, calendar_id string, last_sync_at timestamp")
    parts = state_parts(state, headers, per_part=20).cache()
    assert parts.where("feed_id = 'a'").count() > 10
    whole = parts.groupBy("feed_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "text"))), lambda p: p.text), "\n").alias("json"))
    assert {r.feed_id: len(json.loads(r.json)["events"]) for r in whole.collect()} == {"a": sum(f == "a" for f, _ in rows), "b": 1, "c": sum(f == "c" for f, _ in rows), "d": 0}
    back, heads, dropped = revive_state(whole)
    assert {(r.feed_id, r.uid): (r.event_id, r.hash, r.start) for r in back.collect()} == rows
    assert {r.feed_id: (r.calendar_id, r.last_sync_at, r.was_reset) for r in heads.collect()} == {
        "a": ("cal", synced, False), "d": (None, synced, False), "b": (None, dt.datetime(1970, 1, 1), False), "c": (None, dt.datetime(1970, 1, 1), False)
    }
    assert dropped.agg(F.sum("dropped")).first()[0] == 0
    parts.unpersist()


def test_a_store_is_exported_and_begun_again_with_its_log(spark, folder):
    h = Harness(spark, folder)
    h.land(ics(*SHOWS[:2]))
    h.go()
    before = h.state()
    export_states(spark, h.store, folder + "/out", per_part=1)
    blobs = read_states(spark, folder + "/out")
    entry = {"summary": "s", "start": "2026-01-01", "addedAt": "a", "eventId": "e", "feedId": "f"}
    stored = [{**entry, "uid": "old-1"}, {**entry, "uid": "old-2", "start": "2026-02-01"}, {**entry, "uid": "other", "feedId": "x"}, {"uid": 1}]
    log = spark.createDataFrame([(json.dumps({"version": 1, "entries": stored}),)], "json string")
    h.store = Store(folder + "/second", buckets=4)
    adopt(spark, h.store, blobs, log_json=log).collect()
    assert {u: r[2:] for u, r in h.state().items()} == {u: r[2:] for u, r in before.items()}
    assert [r.uid for r in recent_additions(spark, h.store, 10).collect()] == ["old-1", "old-2", "other"]
    h.land(ics(*SHOWS))
    assert h.go() == {"f": (1, 0, 0, 2, 0, 0, None)}
    assert [r.uid for r in recent_additions(spark, h.store, 3).collect()] == ["ep-3", "old-1", "old-2"]
    assert [r.uid for r in recent_additions(spark, h.store, 1).collect()] == ["ep-3"]
    limited = h.feeds.withColumn("recent_limit", F.lit(2).cast("bigint"))
    assert sorted(r.uid for r in feed_additions(spark, h.store, limited).collect()) == ["ep-3", "old-1"]
    assert current_state(spark, h.store).count() == 3
