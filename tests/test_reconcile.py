import datetime as dt

import pytest
from pyspark.sql import functions as F

from snapfold.operators import spread
from snapfold.operators.fold import additions, fold, outcomes, run_alerts, summarise
from snapfold.operators.reconcile import (
    CHANGES,
    action_counts,
    list_actions,
    reconcile,
    shared_digests,
    vanished,
)
from snapfold.schemas import EVENTS, STATE
from snapfold.sources.state import write_keyed

NOW = dt.datetime(2026, 7, 27, 12)
RUNS = "feed_id string, now timestamp, state_retention_days int"


def events_of(spark, *rows):
    """rows: (feed, uid, hash, start)"""
    full = [
        (f, 1, u, i, f"title {u}", None, None, s, s + dt.timedelta(minutes=30), False, h)
        for i, (f, u, h, s) in enumerate(rows)
    ]
    return spark.createDataFrame(full, EVENTS)


def state_of(spark, *rows):
    """rows: (feed, uid, hash, start text)"""
    return spark.createDataFrame([(f, u, f"id-{u}", h, s) for f, u, h, s in rows], STATE)


def runs_of(spark, *feeds):
    return spark.createDataFrame([(f, NOW, 30) for f in feeds], RUNS)


AHEAD = dt.datetime(2026, 8, 1)


def test_actions(spark):
    events = events_of(
        spark,
        ("f", "new", "h1", AHEAD),
        ("f", "changed", "h2", AHEAD),
        ("f", "same", "h3", AHEAD),
        ("f", "old-same", "h4", dt.datetime(2020, 1, 1)),
        ("f", "constructor", "h5", AHEAD),
        ("other", "same", "h6", AHEAD),
        ("gated", "g1", "h7", AHEAD),
    )
    state = state_of(
        spark,
        ("f", "changed", "hx", "2026-08-01T00:00:00.000Z"),
        ("f", "same", "h3", "2026-08-01T00:00:00.000Z"),
        ("f", "old-same", "h4", "2020-01-01T00:00:00.000Z"),
        ("f", "gone-ahead", "h", "2026-08-01T00:00:00.000Z"),
        ("f", "gone-week", "h", "2026-07-20T00:00:00.000Z"),
        ("f", "gone-long", "h", "2026-01-01T00:00:00.000Z"),
        ("f", "gone-yesterday", "h", "2026-07-26T00:00:00.000Z"),
        ("f", "gone-now", "h", "2026-07-27T12:00:00.000Z"),
        ("f", "gone-next-ms", "h", "2026-07-27T12:00:00.001Z"),
        ("f", "gone-at-cutoff", "h", "2026-06-27T12:00:00.000Z"),
        ("f", "gone-unreadable", "h", "not-a-date"),
        ("gated", "g2", "h", "2026-08-01T00:00:00.000Z"),
        ("silent", "s", "h", "2026-08-01T00:00:00.000Z"),
    )
    runs = runs_of(spark, "f", "other")
    want = {
        ("f", "new"): "create",
        ("f", "changed"): "update",
        ("f", "same"): "unchanged",
        ("f", "old-same"): "unchanged",
        ("f", "constructor"): "create",
        ("other", "same"): "create",
        ("f", "gone-ahead"): "delete",
        ("f", "gone-week"): "retain",
        ("f", "gone-long"): "prune",
        ("f", "gone-yesterday"): "retain",
        ("f", "gone-now"): "retain",
        ("f", "gone-next-ms"): "delete",
        ("f", "gone-at-cutoff"): "retain",
        ("f", "gone-unreadable"): "prune",
    }
    got = reconcile(events, state, runs)
    assert {(r.feed_id, r.uid): r.action for r in got.collect()} == want
    left = {r.uid for r in vanished(state, events).where("feed_id = 'f'").collect()}
    assert left == {u for f, u in want if f == "f" and u.startswith("gone")}
    counts = {(r.feed_id, r.action): r.n for r in action_counts(got).collect()}
    assert counts[("f", "retain")] == 4 and counts[("f", "prune")] == 2


def test_wide_registry_uses_the_salted_join(spark, monkeypatch):
    events = events_of(spark, *[("f", f"u{i}", "h", AHEAD) for i in range(50)])
    state = state_of(spark, ("f", "u1", "h", "2026-08-01T00:00:00.000Z"), ("x", "u2", "h", "x"))
    runs = runs_of(spark, "f")
    columns = ("feed_id", "uid", "action")
    broadcast = reconcile(events, state, runs).select(*columns).collect()
    for hot_rows in (10, 1000):
        monkeypatch.setattr(spread, "HOT_ROWS", hot_rows)
        spread_out = reconcile(events, state, runs, small=False).select(*columns).collect()
        assert sorted(broadcast) == sorted(spread_out) and len(spread_out) == 50


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_attach_gives_the_same_rows_either_way(spark, monkeypatch, how):
    rows = [("a", i) for i in range(40)] + [("b", 1), ("c", 2), (None, 3), (None, 4)]
    df = spark.createDataFrame(rows, "feed_id string, uid int")
    dim = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 3.0)], "feed_id string, x double")
    monkeypatch.setattr(spread, "HOT_ROWS", 10)
    ways = [spread.attach(df, dim, how=how, small=small).collect() for small in (True, False)]
    plain = df.join(dim, "feed_id", how).collect()
    assert sorted(map(repr, ways[0])) == sorted(map(repr, ways[1])) == sorted(map(repr, plain))


def test_full_outer_join_plan(spark):
    events = events_of(spark, ("f", "a", "h", AHEAD))
    plan = reconcile(events, state_of(spark, ("f", "b", "h", "x")), runs_of(spark, "f"))
    text = plan._jdf.queryExecution().toString()
    assert "SortMergeJoin [feed_id" in text and "FullOuter" in text
    assert "CartesianProduct" not in text and "ArrowEvalPython" not in text


def test_bucketed_state_is_not_shuffled(spark, folder):
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    state = state_of(spark, *[("f", f"u{i}", "h", "2026-08-01T00:00:00.000Z") for i in range(20)])
    table = write_keyed(spark, state, folder + "/state", 1, buckets)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        events = events_of(spark, ("f", "u1", "h", AHEAD), ("f", "a", "h", AHEAD))
        actions = reconcile(events, table, runs_of(spark, "f"))
        plan = actions._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(feed_id") == 1
        assert actions.count() == 21
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


RESULTS = "run_seq bigint, feed_id string, uid string, kind string, ok boolean, status int, event_id string, error string"


def test_fold(spark):
    events = events_of(
        spark,
        *[("f", u, "new", AHEAD) for u in ("c-ok", "c-500", "c-noid", "u-ok", "u-404", "u-500", "same")],
    )
    state = state_of(
        spark,
        *[("f", u, "old", "2026-08-02T00:00:00.000Z") for u in ("u-ok", "u-404", "u-500")],
        ("f", "same", "new", "2026-08-01T00:00:00.000Z"),
        *[("f", u, "old", "2026-08-02T00:00:00.000Z") for u in ("d-ok", "d-404", "d-500")],
        ("f", "retained", "old", "2026-07-20T00:00:00.000Z"),
        ("f", "pruned", "old", "2020-07-20T00:00:00.000Z"),
        ("away", "x", "old", "2026-08-02T00:00:00.000Z"),
    )
    results = spark.createDataFrame(
        [
            (1, "f", "c-ok", "create", True, 201, "new-id", None),
            (1, "f", "c-500", "create", False, 500, None, "boom"),
            (1, "f", "c-noid", "create", False, 502, None, None),
            (1, "f", "u-ok", "update", True, 200, None, None),
            (1, "f", "u-404", "update", False, 404, None, None),
            (1, "f", "u-500", "update", False, 500, None, None),
            (1, "f", "d-ok", "delete", True, 204, None, None),
            (1, "f", "d-404", "delete", False, 404, None, None),
            (1, "f", "d-500", "delete", False, 500, None, None),
            (1, "f", "unknown", "create", False, 400, None, None),
        ],
        RESULTS,
    )
    runs = runs_of(spark, "f")
    actions = reconcile(events, state, runs)
    settled = outcomes(actions, results)
    folded = {(r.feed_id, r.uid): (r.event_id, r.hash, r.start) for r in fold(state, settled).collect()}
    kept = {uid: row for (feed, uid), row in folded.items() if feed == "f"}
    old = "2026-08-02T00:00:00.000Z"
    want = {
        "c-ok": ("new-id", "new", "2026-08-01T00:00:00.000Z"),
        "u-ok": ("id-u-ok", "new", "2026-08-01T00:00:00.000Z"),
        "u-500": ("id-u-500", "old", old),
        "d-500": ("id-d-500", "old", old),
        "same": ("id-same", "new", "2026-08-01T00:00:00.000Z"),
        "retained": ("id-retained", "old", "2026-07-20T00:00:00.000Z"),
    }
    assert kept == want
    assert folded[("away", "x")] == ("id-x", "old", old)
    changes = actions.where(F.col("action").isin(*CHANGES))
    again = {(r.feed_id, r.uid): tuple(r)[2:] for r in fold(state, outcomes(changes, results)).collect()}
    assert again == folded
    report = run_alerts(summarise(settled)).collect()
    assert len(report) == 1
    got = report[0].asDict()
    assert got == {
        "feed_id": "f",
        "created": 1,
        "updated": 1,
        "deleted": 2,
        "skipped": 1,
        "pruned": 1,
        "errors": 5,
        "aborted": None,
        "level": "degraded",
    }
    added = additions(settled, F.lit("2026-07-27T12:00:00.000Z")).collect()
    assert [(r.uid, r.event_id, r.summary) for r in added] == [("c-ok", "new-id", "title c-ok")]


def test_listing_is_paged_and_whole(spark):
    actions = spark.range(2500).select(
        F.lit("f").alias("feed_id"), F.concat(F.lit("u"), "id").alias("uid"), F.lit("create").alias("action")
    )
    pages = list_actions(actions, page_size=1000).orderBy("page").collect()
    assert [(p.page, p.n) for p in pages] == [(0, 1000), (1, 1000), (2, 500)]
    assert {u for p in pages for u in p.uids} == {f"u{i}" for i in range(2500)}


def test_shared_digests(spark):
    events = events_of(spark, ("f", "a", "h", AHEAD), ("f", "b", "h", AHEAD), ("g", "a", "h", AHEAD))
    assert [tuple(r) for r in shared_digests(events).collect()] == [("f", "h", 2, "a")]


@pytest.mark.parametrize("rows", [0, 1, 19, 20, 45])
def test_positions(spark, rows):
    from snapfold.operators.batching import assign_batches, dispatch_counts, number_ops

    kinds = ["create", "update", "delete"]
    data = [
        ("f", f"u{i:03}", kinds[i % 3], None if i % 3 == 2 else i * 7919) for i in range(rows)
    ]
    ops = spark.createDataFrame(
        data, "feed_id string, uid string, kind string, feed_ord bigint"
    )
    got = assign_batches(number_ops(ops)).orderBy("op_ord").collect()
    assert [r.op_ord for r in got] == list(range(rows))
    assert [r.batch_id for r in got] == [i // 20 for i in range(rows)]
    assert [r.id for r in got] == [f"op-{i}" for i in range(rows)]
    assert [r.kind for r in got] == sorted((r.kind for r in got), key=kinds.index)
    placed = [r.feed_ord for r in got if r.kind == "create"]
    assert placed == sorted(placed)
    if rows:
        assert [tuple(r) for r in dispatch_counts(ops).collect()] == [("f", rows, -(-rows // 20))]
