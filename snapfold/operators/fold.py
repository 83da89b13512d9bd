"""Fold results back into state, and the run report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapfold.functions.zones import iso_ms

_COUNTS = ("created", "updated", "deleted", "skipped", "pruned", "errors")


def outcomes(actions: DataFrame, results: DataFrame) -> DataFrame:
    """Actions with the ``outcome`` of their result and its ``effect`` on the state row.

    State follows what was achieved, so that the next run repeats the rest: a failed create is not stored,
    a failed update or delete keeps the old row. An update or delete that finds nothing drops the row. A
    result without a matching operation is an error, unless it says that the entry is gone.

    ``outcome`` is created, updated, deleted, vanished, error, or NULL where nothing was sent; ``effect``
    is put (the row becomes ``next``), drop or keep.
    """
    answered = results.select(
        "feed_id",
        "uid",
        F.col("kind").alias("r_kind"),
        F.col("ok").alias("r_ok"),
        F.col("status").alias("r_status"),
        F.col("event_id").alias("r_event_id"),
    )
    both = actions.join(answered, ["feed_id", "uid"], "full_outer")
    matches = F.coalesce(F.col("action") == F.col("r_kind"), F.lit(False))
    gone = F.col("r_status") == 404
    has_id = F.coalesce(F.col("r_event_id"), F.lit("")) != ""
    outcome = (
        F.when(F.col("r_kind").isNull(), F.lit(None).cast("string"))
        .when(
            F.col("r_kind") == "create",
            F.when(F.col("r_ok") & has_id & matches, "created").otherwise("error"),
        )
        .when(
            F.col("r_kind") == "update",
            F.when(gone, "vanished").when(F.col("r_ok") & matches, "updated").otherwise("error"),
        )
        .otherwise(F.when(F.col("r_ok") | gone, "deleted").otherwise("error"))
    )
    effect = (
        F.when(F.col("outcome").isin("created", "updated"), "put")
        .when(F.col("outcome").isin("deleted", "vanished") | (F.col("action") == "prune"), "drop")
        .otherwise("keep")
    )
    created = F.col("outcome") == "created"
    fresh = F.struct(
        F.when(created, F.col("r_event_id")).otherwise(F.col("event_id")).alias("event_id"),
        F.col("hash").alias("hash"),
        iso_ms(F.col("start")).alias("start"),
    )
    return (
        both.withColumn("outcome", outcome)
        .withColumn("effect", effect)
        .withColumn("next", F.when(F.col("effect") == "put", fresh))
    )


def fold(state: DataFrame, settled: DataFrame) -> DataFrame:
    """Whole next state: the rows with an effect change, all others stay, of whatever feed.

    ``settled`` needs only the changed keys. Where the state is bucketed by key only ``settled`` moves.
    """
    changed = settled.where(F.col("effect") != "keep").select("feed_id", "uid", "effect", "next")
    put = F.col("effect") == "put"

    def kept_or_new(name: str) -> Column:
        return F.when(put, F.col(f"next.{name}")).otherwise(F.col(name)).alias(name)

    return (
        state.join(changed, ["feed_id", "uid"], "full_outer")
        .where(F.coalesce(F.col("effect"), F.lit("keep")) != "drop")
        .select("feed_id", "uid", *map(kept_or_new, ("event_id", "hash", "start")))
    )


def summarise(settled: DataFrame) -> DataFrame:
    """Counts per reconciled feed. An update that found nothing is neither an update nor an error."""

    def n(condition: Column, name: str) -> Column:
        return F.count_if(condition).alias(name)

    outcome, action = F.col("outcome"), F.col("action")
    return (
        settled.groupBy("feed_id")
        .agg(
            n(outcome == "created", "created"),
            n(outcome == "updated", "updated"),
            n(outcome == "deleted", "deleted"),
            n(action == "unchanged", "skipped"),
            n(action == "prune", "pruned"),
            n(outcome == "error", "errors"),
        )
        .withColumn("aborted", F.lit(None).cast("string"))
    )


def aborted_summary(rejects: DataFrame) -> DataFrame:
    """All counts zero, one error and the reason, per feed that stopped early."""
    zeros = [F.lit(0).cast("bigint").alias(c) for c in _COUNTS if c != "errors"]
    return rejects.select("feed_id", *zeros, F.lit(1).cast("bigint").alias("errors"), "aborted")


def run_alerts(summary: DataFrame) -> DataFrame:
    """``level`` per run: aborted, degraded or ok."""
    level = F.when(F.col("aborted").isNotNull(), "aborted").when(F.col("errors") > 0, "degraded")
    return summary.withColumn("level", level.otherwise("ok"))


def additions(settled: DataFrame, added_at: Column) -> DataFrame:
    """Successful creates as rows of the recent log; ``ord`` is their place in the feed."""
    return settled.where(F.col("outcome") == "created").select(
        "feed_id",
        "uid",
        "summary",
        iso_ms(F.col("start")).alias("start"),
        added_at.alias("added_at"),
        F.col("r_event_id").alias("event_id"),
        F.col("feed_ord").alias("ord"),
    )


def advance_feed_state(feed_state: DataFrame, finished: DataFrame) -> DataFrame:
    """Headers after a run: rows of ``finished`` replace, all others stay as they were."""
    kept = feed_state.join(finished.select("feed_id"), "feed_id", "left_anti")
    return kept.unionByName(finished.select(*feed_state.columns))


def feed_status(state: DataFrame, feed_state: DataFrame, feeds: DataFrame) -> DataFrame:
    """Per registered feed: calendar resolved, tracked events, last sync (epoch if never)."""
    tracked = state.groupBy("feed_id").agg(F.count(F.lit(1)).alias("tracked_events"))
    return (
        feeds.select("feed_id", "calendar_name")
        .join(feed_state.select("feed_id", "calendar_id", "last_sync_at"), "feed_id", "left")
        .join(tracked, "feed_id", "left")
        .select(
            "feed_id",
            "calendar_name",
            F.col("calendar_id").isNotNull().alias("calendar_resolved"),
            F.coalesce("tracked_events", F.lit(0)).alias("tracked_events"),
            iso_ms(F.coalesce("last_sync_at", F.timestamp_seconds(F.lit(0)))).alias("last_sync_at"),
        )
    )
