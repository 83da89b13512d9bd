"""State as a base and a log of changes, against a state that is rewritten as a whole."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from snapfold import schemas
from snapfold.operators.fold import fold
from snapfold.plans.run import Store, _advance, _state_of
from snapfold.sources.state import Layout, feed_bucket, read_state, wanted_buckets, write_base, write_changes

SETTLED = "feed_id string, uid string, effect string, next struct<event_id: string, hash: string, start: string>"


def size(folder):
    return sum(os.path.getsize(f"{d}/{x}") for d, _, names in os.walk(folder) for x in names if x.endswith(".parquet"))


def settled_of(spark, rows):
    return spark.createDataFrame([(f, u, e, n and (n, f"h-{n}", None)) for f, u, e, n in rows], SETTLED)


def test_twenty_runs_equal_the_full_rewrite(spark, folder):
    rnd, store, layout = random.Random(1), Store(folder + "/store", 3, 4, compact_every=6), None
    want, bases = {}, set()
    for run_seq in range(20):
        rows = []
        for key in rnd.sample([(f"f{i % 5}", f"u{i}") for i in range(60)], rnd.choice([0, 1, 9, 30])):
            effect = rnd.choice(["put", "put", "drop", "keep"])
            rows.append((*key, effect, f"{run_seq}" if effect == "put" else None))
            if effect == "put":
                want[key] = f"{run_seq}"
            elif effect == "drop":
                want.pop(key, None)
        layout = _advance(spark, store, run_seq, layout, settled_of(spark, rows))
        bases.add(layout.base)
        if run_seq % 4 == 3:
            got = {(r.feed_id, r.uid): r.event_id for r in _state_of(spark, store, layout).collect()}
            assert got == want, run_seq
    assert 2 < len(bases) < 8 and len(layout.log) < 6
    one = spark.createDataFrame([("f1",)], "feed_id string")
    mine = _state_of(spark, store, layout, one).where("feed_id = 'f1'").collect()
    assert {r.uid: r.event_id for r in mine} == {u: v for (f, u), v in want.items() if f == "f1"}


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """1,000 feeds of which one has nine tenths of the rows, as a base, and a change of 1 % of the keys of one feed."""
    root = str(tmp_path_factory.mktemp("large"))
    hot = F.col("id") % 10 != 0
    rows = spark.range(200_000).select(
        F.when(hot, "f0").otherwise(F.concat(F.lit("f"), (F.col("id") / 10 % 1000).cast("int"))).alias("feed_id"),
        F.concat(F.lit("u"), "id").alias("uid"),
        F.sha2(F.col("id").cast("string"), 256).alias("event_id"),
        F.sha2(F.col("id").cast("string"), 256).alias("hash"),
        F.lit("2026-08-01T21:00:00.000Z").alias("start"),
    )
    layout = Layout(1, (), 4, 16)
    write_base(rows.repartition(4, "feed_id", "uid"), root + "/state", 1, layout)
    changed = rows.where("feed_id = 'f0' AND hash(uid) % 100 = 7")
    settled = changed.select("feed_id", "uid", F.lit("put").alias("effect"), F.struct("event_id", F.lit("new").alias("hash"), "start").alias("next"))
    assert write_changes(settled, root + "/log", 2, 16)
    return root, Layout(1, (2,), 4, 16), rows, settled


def test_a_small_change_writes_little(spark, large):
    root, *_ = large
    assert size(root + "/log") < 0.02 * size(root + "/state")
    assert not write_changes(settled_of(spark, [("f", "u", "keep", None)]), root + "/none", 3, 16)
    assert size(root + "/none") == 0


def test_changes_come_on_top(spark, large):
    root, layout, rows, settled = large
    got = read_state(spark, root + "/state", root + "/log", layout)
    want = fold(rows, settled)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_only_the_buckets_of_the_feeds_are_read(spark, large):
    root, layout, rows, _ = large
    one = spark.createDataFrame([("f7",)], "feed_id string")
    wanted = wanted_buckets(one, layout)
    state = read_state(spark, root + "/state", root + "/log", layout, wanted)
    assert len(wanted) == 1
    plan = state._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan parquet" in x]
    assert len(scans) >= 2 and all(re.search(rf"PartitionFilters: \[.*feed_bucket#\d+ = {wanted[0]}\)", x) for x in scans)
    assert state.where("feed_id = 'f7'").count() == rows.where("feed_id = 'f7'").count()


def test_a_hot_feed_is_spread_and_the_base_stays(spark, large):
    root, layout, rows, _ = large
    bucket = wanted_buckets(spark.createDataFrame([("f0",)], "feed_id string"), layout)[0]
    files = [os.path.getsize(f"{root}/state/run_seq=1/feed_bucket={bucket}/{x}") for x in os.listdir(f"{root}/state/run_seq=1/feed_bucket={bucket}") if x.endswith(".parquet")]
    assert len(files) == 4 and max(files) < 1.2 * min(files)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        events = rows.select("feed_id", "uid", F.lit(1).alias("seen")).repartition(4, "feed_id", "uid")
        state = read_state(spark, root + "/state", root + "/log", layout, [bucket])
        plan = state.join(events, ["feed_id", "uid"], "full_outer")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the base is read bucketed: of what lies between its scan and the join nothing is an exchange
    lines = plan.splitlines()
    scan = next(i for i, x in enumerate(lines) if "FileScan parquet" in x and "Bucketed: true" in x)
    depth = lines[scan].index("FileScan")
    above = []
    for x in reversed(lines[:scan]):
        at = re.search(r"[A-Za-z]", x).start()
        if at < depth:
            above.append(x)
            depth = at
    assert not any("Exchange" in x for x in above)


def test_feed_bucket_of_null(spark):
    row = spark.createDataFrame([(None,), ("a",)], "feed_id string").select(feed_bucket(8).alias("b")).collect()
    assert all(0 <= r.b < 8 for r in row)
    assert schemas.STATE_LOG.endswith("feed_bucket int")
