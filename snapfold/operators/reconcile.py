"""Snapshot against state: the gate, the full outer join and the decision per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapfold.functions.zones import DAY_MS, at_most_longest, parse_iso
from snapfold.operators.spread import attach, digest_bucket, fits_broadcast, position_within
from snapfold.schemas import EVENT_FIELDS

# Why a feed's run stops without touching anything.
FETCH_FAILED = "ics-fetch-failed"
PARSE_FAILED = "ics-parse-failed"
FEED_EMPTY = "ics-feed-empty"
TARGET_FAILED = "calendar-resolve-failed"
APPLY_FAILED = "apply-failed"

# The actions of a key. Only the first four change the state or need an operation.
CHANGES = ("create", "update", "delete", "prune")
ACTIONS = (*CHANGES, "unchanged", "retain")


def gate(snapshots: DataFrame, documents: DataFrame, decoded: DataFrame) -> DataFrame:
    """Outcome per snapshot: ``aborted`` is NULL if it may be reconciled, else the reason.

    ``snapshots`` has a row per poll with the number of parts it should have, ``documents`` the admitted
    parts. A part that is missing or was not admitted is a failed fetch, never an empty feed.
    """
    key = ["feed_id", "snapshot_seq"]
    arrived = documents.groupBy(*key).agg(F.countDistinct("part").alias("arrived"))
    read = decoded.groupBy(*key).agg(
        F.bool_or("bad").alias("bad"), F.count_if(F.col("kept")).alias("events")
    )
    aborted = (
        F.when(F.coalesce("arrived", F.lit(0)) < F.col("parts"), FETCH_FAILED)
        .when(F.coalesce("bad", F.lit(False)), PARSE_FAILED)
        .when(F.coalesce("events", F.lit(0)) == 0, FEED_EMPTY)
    )
    return (
        snapshots.join(arrived, key, "left")
        .join(read, key, "left")
        .withColumn("aborted", aborted)
        .withColumn("events", F.coalesce("events", F.lit(0)))
        .drop("arrived", "bad")
    )


def is_deletable(start: Column, now: Column) -> Column:
    """A key that left the feed is deleted only if its event is still ahead, strictly."""
    return F.coalesce(start > now, F.lit(False))


def is_prunable(start: Column, now: Column, retention_days: Column) -> Column:
    """A key that left the feed is forgotten if its start is unreadable or past the retention.

    A retention longer than all time is never over.
    """
    days = at_most_longest(retention_days.cast("bigint"), 1)
    cutoff = F.unix_micros(now) - days * (DAY_MS * 1000)
    return F.coalesce(F.unix_micros(start) < cutoff, F.lit(True))


def reconcile(
    events: DataFrame, state: DataFrame, runs: DataFrame, small: bool | None = None
) -> DataFrame:
    """One row per key of the usable feeds with its ``action``, event columns and stored columns.

    ``events`` and ``state`` have one row per (feed_id, uid); ``runs`` has one row per usable feed with
    its clock ``now`` and ``state_retention_days``. Both sides are restricted to those feeds, because the
    state of a feed without a usable snapshot would otherwise look as if everything had vanished. Keys
    are unique on both sides, so the join has no hot key whatever share of the rows one feed has.
    ``small`` passes on a size check of ``runs`` that was already made.
    """
    feeds = runs.select("feed_id", "now", "state_retention_days")
    small = fits_broadcast(feeds) if small is None else small
    fresh = attach(events, feeds.select("feed_id"), how="left_semi", small=small).select(
        "feed_id", "uid", *EVENT_FIELDS
    )
    known = attach(state, feeds, small=small).select(
        "feed_id",
        "uid",
        "event_id",
        F.col("hash").alias("stored_hash"),
        F.col("start").alias("stored_start"),
        "now",
        "state_retention_days",
    )
    in_feed = F.col("hash").isNotNull()
    stored = F.col("event_id").isNotNull()
    start = parse_iso(F.col("stored_start"))
    action = (
        F.when(in_feed & ~stored, "create")
        .when(in_feed & (F.col("stored_hash") != F.col("hash")), "update")
        .when(in_feed, "unchanged")
        .when(is_deletable(start, F.col("now")), "delete")
        .when(is_prunable(start, F.col("now"), F.col("state_retention_days")), "prune")
        .otherwise("retain")
    )
    return (
        fresh.join(known, ["feed_id", "uid"], "full_outer")
        .withColumn("action", action)
        .drop("now", "state_retention_days")
    )


def vanished(state: DataFrame, events: DataFrame) -> DataFrame:
    """State keys that are not in the feed."""
    return state.join(events.select("feed_id", "uid"), ["feed_id", "uid"], "left_anti")


def action_counts(actions: DataFrame) -> DataFrame:
    """Rows per feed and action."""
    return actions.groupBy("feed_id", "action").agg(F.count(F.lit(1)).alias("n"))


def list_actions(actions: DataFrame, page_size: int = 1000) -> DataFrame:
    """Count and uids per feed and action, the uids in pages so that no list grows with the feed."""
    group = ["feed_id", "action"]
    bucketed = actions.select(*group, "uid").withColumn("__bucket", digest_bucket(F.col("uid")))
    placed = position_within(bucketed, group, "__bucket", ["uid"], "at")
    paged = placed.withColumn("page", F.floor(F.col("at") / page_size))
    return paged.groupBy(*group, "page").agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("uid")).alias("uids")
    )


def shared_digests(events: DataFrame) -> DataFrame:
    """Digests that several uids of a feed share; a service that dedupes creates by digest drops one.

    Counts only, so a group of any size is one row.
    """
    return (
        events.groupBy("feed_id", "hash")
        .agg(F.count(F.lit(1)).alias("uids"), F.min("uid").alias("first_uid"))
        .where("uids > 1")
    )
