"""The one-job replay against a literal loop over the snapshots."""

import datetime as dt
import random

import pytest

from snapfold.operators import replay as R
from snapfold.operators import spread

BASE = dt.datetime(2026, 1, 1)
DAY = dt.timedelta(days=1)


def loop(history, retention):
    """history: list of (seq, now, {uid: (hash, start)}); returns the set of actions."""
    state, out = {}, set()
    for seq, now, feed in history:
        cutoff = now - retention * DAY
        for uid, (digest, start) in feed.items():
            old = state.get(uid)
            action = "create" if old is None else "update" if old[0] != digest else "unchanged"
            out.add((seq, uid, action))
            state[uid] = (digest, start)
        for uid in [u for u in state if u not in feed]:
            start = state[uid][1]
            if start > now:
                out.add((seq, uid, "delete"))
                del state[uid]
            elif start < cutoff:
                out.add((seq, uid, "prune"))
                del state[uid]
    return out


def random_history(rng):
    n = rng.randint(1, 9)
    now, seq, history = BASE, rng.randint(0, 3), []
    for _ in range(n):
        now += rng.choice([0, 0, 6, 24, 24, 40, 24 * 5]) * dt.timedelta(hours=1)
        seq += rng.choice([1, 1, 1, 2, 5000])
        feed = {}
        for uid in "abcd":
            if rng.random() < 0.6:
                start = BASE + rng.randint(-6 * 24, 20 * 24) * dt.timedelta(hours=1)
                feed[uid] = (rng.choice("xy"), start)
        history.append((seq, now, feed))
    return history


@pytest.mark.parametrize(
    "small, chunked, chunk", [(True, False, 65_536), (False, True, 2), (True, True, 3)]
)
def test_replay_equals_loop(spark, monkeypatch, small, chunked, chunk):
    monkeypatch.setattr(R, "CHUNK", chunk)
    monkeypatch.setattr(spread, "HOT_ROWS", 2)
    rng = random.Random(7)
    observed, line, want = [], [], set()
    for i in range(400):
        retention = rng.randint(0, 6)
        history = random_history(rng)
        feed = f"feed-{i}"
        want |= {(feed, *a) for a in loop(history, retention)}
        line += [(feed, seq, now, retention) for seq, now, _ in history]
        observed += [(feed, s, u, h, t) for s, _, fd in history for u, (h, t) in fd.items()]
    observations = spark.createDataFrame(
        observed, "feed_id string, snapshot_seq bigint, uid string, hash string, start timestamp"
    )
    timeline = spark.createDataFrame(
        line, "feed_id string, snapshot_seq bigint, now timestamp, state_retention_days int"
    )
    rows = R.replay(observations, timeline, small, chunked).collect()
    got = {(r.feed_id, r.snapshot_seq, r.uid, r.action) for r in rows}
    assert len(rows) == len(got)
    assert got == want


def test_replay_chooses_its_plan_itself(spark):
    observations = spark.createDataFrame(
        [("f", 1, "a", "h", BASE)],
        "feed_id string, snapshot_seq bigint, uid string, hash string, start timestamp",
    )
    timeline = spark.createDataFrame(
        [("f", 1, BASE, 0), ("f", 2, BASE + DAY, 0)],
        "feed_id string, snapshot_seq bigint, now timestamp, state_retention_days int",
    )
    got = {tuple(r) for r in R.replay(observations, timeline).collect()}
    assert got == {("f", 1, "a", "create"), ("f", 2, "a", "prune")}
