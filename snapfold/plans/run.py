"""One reconciliation run over all feeds: prepare the outbox, apply it outside, finish from the responses.

Every step that later steps read twice is written as a table of the run first. That cuts lineage, so a
lost executor repeats one step, and it makes a repeated run overwrite exactly its own folders. The commit
record comes last; state is only ever found through it.
"""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapfold import schemas
from snapfold.functions.zones import iso_ms, zones
from snapfold.operators.batching import assign_batches, number_ops, operations, outbox
from snapfold.operators.decode import decode, decode_blocks, normalised
from snapfold.operators.fold import (
    aborted_summary,
    additions,
    advance_feed_state,
    outcomes,
    run_alerts,
    summarise,
)
from snapfold.operators.reconcile import (
    APPLY_FAILED,
    CHANGES,
    FETCH_FAILED,
    TARGET_FAILED,
    gate,
    reconcile,
)
from snapfold.operators.settle import operation_results, settle, unmatched
from snapfold.operators.spread import attach, fits_broadcast
from snapfold.operators.targets import resolve_targets
from snapfold.session import configure, require_utc
from snapfold.sources.batchlog import write_outbox
from snapfold.sources.commitlog import read_commits, write_commit
from snapfold.sources.export import state_parts, write_states
from snapfold.sources.folders import exists, remove, runs_below
from snapfold.sources.recent import recent, recent_by_feed, revive_recent, write_recent
from snapfold.sources.snapshots import MAX_DOCUMENT_BYTES, admit, newest_per_feed, polls
from snapfold.sources.state import (
    STATE_VERSION,
    Layout,
    read_state,
    register_keyed,
    revive_state,
    table_name,
    wanted_buckets,
    write_base,
    write_changes,
    write_keyed,
)

log = logging.getLogger(__name__)

# Applies the requests of an outbox and returns the logged responses (schemas.RESPONSES).
Applier = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Store:
    """Folders of a deployment below one shared root.

    State is a base and a log of changes, which are merged into a new base every ``compact_every`` runs that
    change something. Both lie in ``feed_buckets`` folders by feed, of which a run reads those of its feeds;
    the base is bucketed by key in each of them. With at least as many ``buckets`` as shuffle partitions the
    base is never shuffled, with equally many the events are shuffled once. The files of a base, at most
    ``buckets`` times ``feed_buckets``, should have 100 to 500 MB. Commit records are folded into one file when
    there are more than ``fold_every``.
    """

    root: str
    buckets: int = 8
    feed_buckets: int = 16
    compact_every: int = 16
    fold_every: int = 64

    def folder(self, name: str) -> str:
        return f"{self.root}/{name}"

    def of_run(self, name: str, run_seq: int) -> str:
        return f"{self.root}/{name}/run_seq={run_seq}"


def commits(spark: SparkSession, store: Store) -> list:
    """All commit records, newest first, for inspection; runs read one at a time."""
    found = _commit_log(spark, store)
    return [] if found is None else found.orderBy(F.desc("run_seq")).collect()


def _commit_log(spark: SparkSession, store: Store) -> DataFrame | None:
    return read_commits(spark, store.root)


def newest_commit(spark: SparkSession, store: Store, condition: str = "true"):
    """Newest commit that meets a condition, or None."""
    found = _commit_log(spark, store)
    return None if found is None else found.where(condition).orderBy(F.desc("run_seq")).limit(1).first()


def previous(spark: SparkSession, store: Store, run_seq: int):
    """Newest commit before a run, or None."""
    return newest_commit(spark, store, f"run_seq < {run_seq}")


def _layout(commit) -> Layout | None:
    """Layout of the state a commit points to."""
    if commit is None or (commit.base_run_seq is None and not commit.log):
        return None
    return Layout(commit.base_run_seq, tuple(commit.log or ()), commit.buckets, commit.feed_buckets)


def _state_of(
    spark: SparkSession, store: Store, layout: Layout | None, feeds: DataFrame | None = None
) -> DataFrame:
    """State of a layout; with ``feeds``, only the feed buckets that these are in."""
    wanted = None if layout is None or feeds is None else wanted_buckets(feeds, layout)
    return read_state(spark, store.folder("state"), store.folder("state_log"), layout, wanted)


def read_feed_state(spark: SparkSession, store: Store, run_seq: int | None) -> DataFrame:
    if run_seq is None:
        return spark.createDataFrame([], schemas.FEED_STATE)
    return spark.read.schema(schemas.FEED_STATE).parquet(store.of_run("feed_state", run_seq))


def _saved(df: DataFrame, store: Store, name: str, run_seq: int) -> DataFrame:
    folder = store.of_run(name, run_seq)
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def prepare(
    spark: SparkSession,
    store: Store,
    run_seq: int,
    now: dt.datetime,
    documents: DataFrame,
    feeds: DataFrame,
    targets: DataFrame,
    max_bytes: int = MAX_DOCUMENT_BYTES,
    silent: DataFrame | None = None,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """Decode, gate, reconcile and write the outbox of a run; returns the outbox.

    ``documents`` is keyed as in ``sources.snapshots``, ``feeds`` is the checked registry, ``targets`` the
    calendar catalogue; documents of more than ``max_bytes`` are not read. Feeds in ``silent`` (feed_id, see
    ``sources.snapshots.silent_feeds``) that have no snapshot in this run are reported as failed fetches.
    With ``blocks`` (``sources.scan.read_blocks``) documents may be of any size: only their keys are used then.
    """
    require_utc(configure(spark))
    last = previous(spark, store, run_seq)
    feed_state = read_feed_state(spark, store, last and last.feed_state_run_seq)

    # Everything that is attached by feed below has at most a row per registered feed.
    small = fits_broadcast(feeds)
    current = newest_per_feed(documents, feed_state, feeds)
    if blocks is None:
        read = admit(current, max_bytes)
        events = decode(read, feeds, zones(spark))
    else:
        read = current.drop("content")
        wanted = read.select("feed_id", "snapshot_seq").distinct()
        events = decode_blocks(blocks.join(wanted, ["feed_id", "snapshot_seq"], "left_semi"), feeds, zones(spark))
    decoded = _saved(events, store, "decoded", run_seq)

    resolved = resolve_targets(feeds, feed_state, targets)
    gated = gate(polls(current), read, decoded).join(resolved, "feed_id", "left")
    no_target = F.when(F.col("calendar_id").isNull(), TARGET_FAILED)
    gated = gated.withColumn("aborted", F.coalesce("aborted", no_target))
    if silent is not None:
        quiet = silent.select("feed_id").distinct().join(polls(current), "feed_id", "left_anti")
        quiet = quiet.withColumn("aborted", F.lit(FETCH_FAILED))
        gated = gated.unionByName(quiet, allowMissingColumns=True)
    gated = _saved(gated, store, "gate", run_seq)

    runs = (
        gated.where(F.col("aborted").isNull())
        .join(feeds.select("feed_id", "state_retention_days"), "feed_id")
        .withColumn("now", _moment(now))
    )
    state = _state_of(spark, store, _layout(last), runs)
    actions = reconcile(normalised(decoded, ("feed_id", "uid")), state, runs, small)
    changed = F.col("action").isin(*CHANGES)
    payload = (*schemas.EVENT_FIELDS, "event_id", "stored_hash", "stored_start")
    slim = actions.where(F.col("action") != "retain").withColumns(
        {c: F.when(changed, F.col(c)) for c in payload}
    )
    actions = write_keyed(spark, slim, store.folder("actions"), run_seq, store.buckets)

    batched = assign_batches(number_ops(operations(actions)))
    sink = feeds.select("feed_id", "target_upn", "display_tz", "event_category").join(
        gated.select("feed_id", "calendar_id"), "feed_id"
    )
    write_outbox(outbox(batched, sink, run_seq, small), store.folder("outbox"), run_seq)
    return read_outbox(spark, store, run_seq)


def read_outbox(spark: SparkSession, store: Store, run_seq: int) -> DataFrame:
    rows = spark.read.schema(schemas.OUTBOX).parquet(store.of_run("outbox", run_seq))
    return rows.withColumn("run_seq", F.lit(run_seq).cast("bigint"))


def finish(
    spark: SparkSession, store: Store, run_seq: int, now: dt.datetime, responses: DataFrame | None
) -> DataFrame:
    """Settle the responses, fold them into the next state and commit; returns the run summary.

    ``responses`` is None when applying failed outright: the feeds that had operations are then aborted
    and keep their state, so that the next run repeats the work. If the state can't be written the run is
    committed with the state before it, and every feed it changed reports one error more.
    """
    require_utc(configure(spark))
    last = previous(spark, store, run_seq)
    gated = spark.read.parquet(store.of_run("gate", run_seq))
    folder = store.folder("actions")
    actions = spark.table(register_keyed(spark, folder, run_seq, schemas.ACTIONS, store.buckets))
    requests = read_outbox(spark, store, run_seq)
    if responses is None:
        failed = requests.select("feed_id").distinct()
        reason = failed.withColumn("failed", F.lit(APPLY_FAILED))
        gated = attach(gated, reason, how="left", spread_by=("feed_id",))
        gated = gated.withColumn("aborted", F.coalesce("aborted", "failed"))
        actions = attach(actions, failed, how="left_anti")
        requests = requests.limit(0)
        responses = spark.createDataFrame([], schemas.RESPONSES)
    rejects = gated.where(F.col("aborted").isNotNull()).select("feed_id", "aborted")
    usable = gated.where(F.col("aborted").isNull())
    layout = _layout(last)
    feed_state_run_seq = last and last.feed_state_run_seq

    if usable.isEmpty():
        summary = aborted_summary(rejects)
    else:
        changes = actions.where(F.col("action") != "unchanged")
        results = operation_results(settle(requests, responses))
        settled = write_keyed(
            spark, outcomes(changes, results), store.folder("settled"), run_seq, store.buckets
        )
        finished = usable.select(
            "feed_id",
            F.lit(STATE_VERSION).alias("version"),
            "calendar_id",
            _moment(now).alias("last_sync_at"),
            F.col("snapshot_seq").alias("applied_snapshot_seq"),
            F.lit(run_seq).cast("bigint").alias("run_seq"),
        )
        lost = 0
        try:
            advanced = _advance(spark, store, run_seq, layout, settled)
            header = advance_feed_state(read_feed_state(spark, store, feed_state_run_seq), finished)
            _saved(header, store, "feed_state", run_seq)
            layout, feed_state_run_seq = advanced, run_seq
        except Exception:
            # The operations are done, so the run is reported; the next one finds them out again from the old state.
            log.exception("run %s: the operations were applied, but the state could not be written", run_seq)
            lost = 1
        write_recent(additions(settled, iso_ms(_moment(now))), store.folder("recent"), run_seq)
        # Every usable feed has events, hence rows to count.
        counted = ["feed_id", "action", "outcome"]
        unchanged = actions.where(F.col("action") == "unchanged").withColumn("outcome", F.lit(None))
        rows = settled.select(*counted).unionByName(unchanged.select(*counted))
        # An answer to no request never gives a uid an id, but it shows in the summary.
        errors = F.col("errors") + F.coalesce("unmatched", F.lit(0)) + lost
        counts = summarise(rows).join(unmatched(requests, responses), "feed_id", "left")
        counts = counts.withColumn("errors", errors).drop("unmatched")
        summary = counts.unionByName(aborted_summary(rejects))

    summary = summary.withColumn("run_seq", F.lit(run_seq).cast("bigint"))
    summary = _saved(run_alerts(summary), store, "summary", run_seq)
    _commit(spark, store, run_seq, layout, feed_state_run_seq)
    return summary


def _advance(
    spark: SparkSession, store: Store, run_seq: int, layout: Layout | None, settled: DataFrame
) -> Layout:
    """Layout of the state after a run: its changes are logged, and merged into a new base when it is time.

    A first base, and one after the numbers of buckets have changed, is written at once.
    """
    if layout is None:
        layout = Layout(None, (), store.buckets, store.feed_buckets)
    moved = (layout.buckets, layout.feed_buckets) != (store.buckets, store.feed_buckets)
    if write_changes(settled, store.folder("state_log"), run_seq, layout.feed_buckets):
        layout = replace(layout, log=(*layout.log, run_seq))
    if layout.base is not None and not moved and len(layout.log) < store.compact_every:
        return layout
    whole = Layout(run_seq, (), store.buckets, store.feed_buckets)
    write_base(_state_of(spark, store, layout), store.folder("state"), run_seq, whole)
    return whole


def _commit(
    spark: SparkSession, store: Store, run_seq: int, layout: Layout | None, feed_state_run_seq: int | None
) -> None:
    state = layout or Layout(None, (), store.buckets, store.feed_buckets)
    row = (run_seq, state.base, list(state.log), feed_state_run_seq, state.buckets, state.feed_buckets)
    write_commit(spark, store.root, row, store.fold_every)


#: What a run leaves that nothing reads once the run is committed and another follows.
RUN_FOLDERS = ("decoded", "gate", "actions", "outbox", "responses", "settled", "summary")


def vacuum(spark: SparkSession, store: Store, keep: int = 2) -> int:
    """Remove what the newest ``keep`` commits don't need; returns the number of folders removed.

    The state's bases and changes, the feed headers and the run folders of older runs go, with their tables
    in the catalogue, unless a kept commit refers to them. So do those of runs that stopped before they were
    committed, but not of a run after the newest commit, which may be under way. The log of additions stays.
    """
    found = _commit_log(spark, store)
    kept = [] if found is None else found.orderBy(F.desc("run_seq")).limit(max(keep, 1)).collect()
    if not kept:
        return 0
    newest, oldest = kept[0].run_seq, kept[-1].run_seq
    needed = {
        "state": {c.base_run_seq for c in kept},
        "state_log": {r for c in kept for r in c.log or ()},
        "feed_state": {c.feed_state_run_seq for c in kept},
    }
    removed = 0
    for name in (*needed, *RUN_FOLDERS):
        for run_seq in runs_below(spark, store.folder(name)):
            if run_seq >= oldest if name not in needed else run_seq in needed[name] or run_seq > newest:
                continue
            spark.sql(f"DROP TABLE IF EXISTS {table_name(store.folder(name), run_seq)}")
            remove(spark, store.of_run(name, run_seq))
            removed += 1
    return removed


def export_states(spark: SparkSession, store: Store, path: str, per_part: int = 10_000) -> None:
    """Write the newest state as one JSON file per feed, which ``adopt`` can read again."""
    last = newest_commit(spark, store)
    headers = read_feed_state(spark, store, last and last.feed_state_run_seq)
    write_states(state_parts(_state_of(spark, store, _layout(last)), headers, per_part), path)


def adopt(
    spark: SparkSession, store: Store, blobs: DataFrame, run_seq: int = 0, log_json: DataFrame | None = None
) -> DataFrame:
    """Begin a store with stored JSON states (feed_id, json), so that a first run re-creates nothing.

    ``log_json`` (json) brings in a stored log of recent additions. Its entries count as additions of runs before
    all runs of the store, one each, so that they keep their stored order behind whatever is added later.
    Returns (feed_id, was_reset, dropped): whether a feed's text was unusable as a whole, and its broken
    entries. A store that has a commit is left alone, as its own state is newer.
    """
    require_utc(configure(spark))
    if newest_commit(spark, store):
        raise ValueError(f"{store.root} has state already")
    state, headers, dropped = revive_state(blobs)
    fields = [x.split()[0] for x in schemas.STATE.split(", ")]
    layout = Layout(run_seq, (), store.buckets, store.feed_buckets)
    dealt = state.select(*fields).repartition(store.buckets, "feed_id", "uid")
    write_base(dealt, store.folder("state"), run_seq, layout)
    header = headers.select(
        "feed_id",
        "version",
        "calendar_id",
        "last_sync_at",
        F.lit(None).cast("bigint").alias("applied_snapshot_seq"),
        F.lit(run_seq).cast("bigint").alias("run_seq"),
    )
    _saved(header, store, "feed_state", run_seq)
    if log_json is not None:
        entries = revive_recent(log_json).withColumn("run_seq", -1 - F.col("ord"))
        names = [x.split()[0] for x in schemas.RECENT.split(", ")]
        entries.select(*names).write.mode("overwrite").parquet(store.folder("recent_adopted"))
    _commit(spark, store, run_seq, layout, run_seq)
    counted = headers.select("feed_id", "was_reset").join(dropped, "feed_id", "left")
    return counted.withColumn("dropped", F.coalesce("dropped", F.lit(0).cast("bigint")))


def _moment(now: dt.datetime) -> Column:
    return F.lit(now).cast("timestamp")


def run(
    spark: SparkSession,
    store: Store,
    run_seq: int,
    now: dt.datetime,
    documents: DataFrame,
    feeds: DataFrame,
    targets: DataFrame,
    applier: Applier,
    max_bytes: int = MAX_DOCUMENT_BYTES,
    silent: DataFrame | None = None,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """Prepare, apply and finish one run. A run that is already committed is left alone."""
    if newest_commit(spark, store, f"run_seq = {run_seq}"):
        return spark.read.parquet(store.of_run("summary", run_seq))
    requests = prepare(spark, store, run_seq, now, documents, feeds, targets, max_bytes, silent, blocks)
    responses: DataFrame | None = spark.createDataFrame([], schemas.RESPONSES)
    if not requests.isEmpty():
        try:
            responses = _saved(applier(requests), store, "responses", run_seq)
        except Exception:
            log.exception("run %s: applying failed; the feeds concerned keep their state", run_seq)
            responses = None
    return finish(spark, store, run_seq, now, responses)


def current_state(spark: SparkSession, store: Store) -> DataFrame:
    """State of the newest commit."""
    return _state_of(spark, store, _layout(newest_commit(spark, store)))


def _adopted(spark: SparkSession, store: Store) -> DataFrame:
    """Entries of the log that the store began with."""
    if not exists(spark, store.folder("recent_adopted")):
        return spark.createDataFrame([], schemas.RECENT)
    return spark.read.schema(schemas.RECENT).parquet(store.folder("recent_adopted"))


def _recent_log(spark: SparkSession, store: Store) -> DataFrame:
    """The log of recent additions of the committed runs."""
    committed = _commit_log(spark, store)
    if committed is None or not exists(spark, store.folder("recent")):
        return spark.createDataFrame([], schemas.RECENT)
    log = spark.read.schema(schemas.RECENT).parquet(store.folder("recent"))
    return log.join(committed.select("run_seq").distinct(), "run_seq", "left_semi")


def recent_additions(spark: SparkSession, store: Store, limit: int) -> DataFrame:
    """The newest additions of committed runs, read from no more runs than can fill the view, then the adopted ones."""
    log, adopted = _recent_log(spark, store), _adopted(spark, store)
    # A run in the log has at least one entry, so this many runs are enough; only the folder column is read.
    newest = log.select("run_seq").distinct().orderBy(F.desc("run_seq")).limit(max(limit, 1))
    oldest = newest.agg(F.min("run_seq")).first()[0]
    if oldest is not None:
        adopted = log.where(F.col("run_seq") >= F.lit(oldest)).unionByName(recent(adopted, limit))
    return recent(adopted, limit)


def feed_additions(spark: SparkSession, store: Store, feeds: DataFrame) -> DataFrame:
    """The newest additions per registered feed, as many as its ``recent_limit``; adopted ones come last."""
    return recent_by_feed(_recent_log(spark, store).unionByName(_adopted(spark, store)), feeds)
