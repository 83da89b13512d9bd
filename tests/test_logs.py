"""The folded commit log, the vacuum and the landing ledger."""

import datetime as dt

from pyspark.sql import functions as F

from snapfold.plans.run import commits, current_state, newest_commit, recent_additions, vacuum
from snapfold.sources import commitlog
from snapfold.sources.commitlog import read_commits, write_commit
from snapfold.sources.folders import runs_below
from snapfold.streaming.ledger import Ledger
from test_run import SHOWS, Harness, ics

NOW = dt.datetime(2026, 7, 27, 12)
DOC = "feed_id string, snapshot_seq bigint, part bigint, parts bigint, snapshot_ts timestamp, length bigint, content binary"


def row(n):
    return (n, 0, [n], n, 8, 16)


def test_commits_are_folded_and_none_is_lost(spark, folder):
    for n in range(11):
        write_commit(spark, folder, row(n), 3)
        if n % 4 == 2:
            found = read_commits(spark, folder)
            assert sorted(r.run_seq for r in found.collect()) == list(range(n + 1))
    assert len(runs_below(spark, folder + "/commits")) <= 6 and len(runs_below(spark, folder + "/commit_log", "upto")) <= 2
    assert {r.run_seq: tuple(r.log) for r in read_commits(spark, folder).collect()} == {n: (n,) for n in range(11)}


def test_ten_thousand_commits_are_few_files(spark, folder):
    many = spark.range(10_000).selectExpr("id run_seq", "0L base_run_seq", "array(id) log", "id feed_state_run_seq", "8 buckets", "16 feed_buckets")
    many.coalesce(1).write.parquet(folder + "/commit_log/upto=9999")
    for n in range(10_000, 10_004):
        write_commit(spark, folder, row(n), 64)
    found = read_commits(spark, folder)
    assert len(found.inputFiles()) == 5 and found.count() == 10_004


def test_a_fold_that_stops_half_way_loses_nothing(spark, folder, monkeypatch):
    def stop(*_):
        raise OSError("lost")

    for n in range(4):
        write_commit(spark, folder, row(n), 2)
    with monkeypatch.context() as m:
        m.setattr(commitlog, "remove", stop)
        for n in (4, 5):
            try:
                write_commit(spark, folder, row(n), 2)
            except OSError:
                assert n == 5
    assert sorted(r.run_seq for r in read_commits(spark, folder).collect()) == list(range(6))
    write_commit(spark, folder, row(6), 2)
    assert sorted(r.run_seq for r in read_commits(spark, folder).collect()) == list(range(7))


def test_vacuum_keeps_what_the_newest_commits_need(spark, folder):
    h = Harness(spark, folder)
    for n in (2, 3, 1):
        h.land(ics(*SHOWS[:n]))
        h.go()
    before, log = h.state(), recent_additions(spark, h.store, 10).count()
    assert vacuum(spark, h.store, keep=1) > 10
    assert runs_below(spark, h.store.folder("decoded")) == [2]
    last = newest_commit(spark, h.store)
    assert runs_below(spark, h.store.folder("state")) == [last.base_run_seq]
    assert runs_below(spark, h.store.folder("state_log")) == sorted(last.log)
    assert h.state() == before and recent_additions(spark, h.store, 10).count() == log
    assert vacuum(spark, h.store, keep=1) == 0
    names = [t.name for t in spark.catalog.listTables() if t.name.startswith("snapfold_")]
    h.land(ics(*SHOWS))
    assert h.go()["f"][0] > 0 and len(commits(spark, h.store)) == 4
    assert len(names) < len([t.name for t in spark.catalog.listTables() if t.name.startswith("snapfold_")])
    assert current_state(spark, h.store).count() == 3


def docs(spark, *parts):
    """parts: (feed, snapshot, part, parts)"""
    return spark.createDataFrame([(*p, NOW + dt.timedelta(minutes=p[1]), 1, None) for p in parts], DOC)


def keys(df):
    return sorted(tuple(r) for r in df.collect())


def test_ledger(spark, folder):
    ledger = Ledger(spark, folder)
    done, begun = ledger.add(0, docs(spark, ("f", 1, 0, 2), ("g", 1, 0, 1), ("h", 5, 0, 3)))
    assert keys(done) == [("g", 1)] and keys(begun) == []
    # a part that lands again completes nothing, the missing one does
    done, begun = ledger.add(1, docs(spark, ("f", 1, 0, 2), ("h", 5, 1, 3)))
    assert keys(done) == [] == keys(begun)
    for _ in range(2):  # a repeated batch does the same
        done, begun = ledger.add(2, docs(spark, ("f", 1, 1, 2), ("f", 2, 0, 2), ("f", 2, 1, 2)))
        assert keys(done) == [("f", 1), ("f", 2)] and keys(begun) == [("f", 1)]
    # the rest of an older snapshot than the newest complete one is not waited for
    done, _ = ledger.add(3, docs(spark, ("h", 6, 0, 1), ("f", 1, 1, 2)))
    assert keys(done) == [("h", 6)]
    assert ledger._read(3, "open", "feed_id string, snapshot_seq bigint").count() == 0
    feeds = spark.createDataFrame([("f",), ("g",), ("h",), ("never",)], "feed_id string")
    late = ledger.silent(3, feeds, NOW + dt.timedelta(minutes=62), dt.timedelta(minutes=60))
    assert sorted(r.feed_id for r in late.collect()) == ["g", "never"]


def test_a_ledger_begins_with_what_has_landed(spark, folder):
    ledger = Ledger(spark, folder)
    landed = docs(spark, ("f", 1, 0, 2), ("g", 1, 0, 1), ("f", 1, 1, 2))
    ledger.begin(7, lambda: landed.where(F.col("part") == 0))
    done, begun = ledger.add(7, docs(spark, ("f", 1, 1, 2)))
    assert keys(done) == [("f", 1)] == keys(begun)
    ledger.begin(8, lambda: 1 / 0)
