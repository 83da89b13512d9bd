"""Incremental runs: every micro-batch of landed documents is one reconciliation run."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from snapfold.plans.run import Applier, Store, newest_commit, run
from snapfold.session import configure
from snapfold.sources.snapshots import FILE_SCHEMA, named, read_folders, read_snapshots
from snapfold.streaming.ledger import Ledger


def start_stream(
    spark: SparkSession,
    store: Store,
    landing: str,
    registry: Callable[[], tuple[DataFrame, DataFrame]],
    applier: Applier,
    clock: Callable[[], dt.datetime],
    max_age: dt.timedelta | None = None,
) -> StreamingQuery:
    """Process what has landed since the last call, then stop; a scheduler calls it again.

    ``registry`` returns the checked feeds and the target catalogue as they are now. A ledger tells which snapshots
    a micro-batch completes: those that it holds as a whole are read from the batch, those that earlier ones began
    from their own folders; the landing folder is not listed again. A snapshot that still lacks a part stays as it
    is until a later batch completes it. Before a run starts its number,
    the one after the newest commit, and its clock are saved under the stream's and the batch's id: a batch
    that Spark repeats is the same run at the same time, and a new stream checkpoint goes on with new numbers.
    With ``max_age`` a run also reports the registered feeds that have landed nothing for so long; a call for
    which nothing at all has landed makes no run.
    """
    configure(spark)
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("pathGlobFilter", "*.ics")
        .load(landing)
    )

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        run_seq, now = _run_of(spark, store, f"{stream}/{batch_id}", clock)
        feeds, targets = registry()
        documents = named(batch)
        ledger = Ledger(spark, f"{store.folder('ledger')}/{stream}")
        ledger.begin(batch_id, lambda: read_snapshots(spark, landing))
        done, begun = ledger.add(batch_id, documents)
        key = ["feed_id", "snapshot_seq"]
        # of registered feeds only, whose names are plain
        known = begun.join(feeds.select("feed_id"), "feed_id", "left_semi")
        begun_keys = [(r.feed_id, r.snapshot_seq) for r in known.collect()]
        mine = documents.join(done.join(begun, key, "left_anti"), key, "left_semi")
        whole = mine.unionByName(read_folders(spark, landing, begun_keys))
        silent = None if max_age is None else ledger.silent(batch_id, feeds, now, max_age)
        run(spark, store, run_seq, now, whole, feeds, targets, applier, silent=silent)

    return (
        files.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", store.folder("stream"))
        .trigger(availableNow=True)
        .start()
    )


def _run_of(
    spark: SparkSession, store: Store, batch: str, clock: Callable[[], dt.datetime]
) -> tuple[int, dt.datetime]:
    """Number and clock of a batch's run: as saved by an earlier try, else new ones, which are saved."""
    folder = f"{store.folder('batches')}/{batch}"
    try:
        saved = spark.read.schema("run_seq bigint, now string").json(folder).first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        saved = None
    if saved is None:
        last = newest_commit(spark, store)
        saved = (last.run_seq + 1 if last else 0, clock().isoformat())
        row = spark.createDataFrame([saved], "run_seq bigint, now string")
        row.coalesce(1).write.mode("overwrite").json(folder)
    return saved[0], dt.datetime.fromisoformat(saved[1])
