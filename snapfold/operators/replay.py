"""Replay a whole snapshot history in one job.

Equivalent to reconciling the snapshots one after another with every write succeeding, but computed per
key from its neighbouring observations, so the number of jobs does not grow with the history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from snapfold.functions.zones import DAY_MS, at_most_longest
from snapfold.operators.spread import BROADCAST_ROWS, attach

DAY_US = DAY_MS * 1000
_SEQ_CHUNK = 4096
# A key has at most one observation per snapshot. Up to this many snapshots per feed its history is
# windowed as one group; beyond it the history is cut into chunks whose edges are stitched.
CHUNK = 65_536


def dense_timeline(timeline: DataFrame, small: bool) -> DataFrame:
    """Usable snapshots numbered ``k`` = 0.. per feed, with the neighbours' and the last clock.

    ``timeline`` has feed_id, snapshot_seq, now, state_retention_days; clocks must not run backwards. A
    small one is windowed by feed. A larger one is windowed in chunks of the snapshot number, and the
    edges of the chunks, a few rows per feed, carry the counts and the clocks across.
    """
    polls = timeline.withColumn("now_us", F.unix_micros("now")).drop("now")
    at = F.struct(F.col("snapshot_seq").alias("seq"), F.col("now_us").alias("us"))
    if small:
        w = W.partitionBy("feed_id").orderBy("snapshot_seq")
        linked = polls.select(
            "*",
            (F.row_number().over(w).cast("bigint") - 1).alias("k"),
            F.lag("now_us").over(w).alias("prev_us"),
            F.lead(at).over(w).alias("__next"),
            F.max("now_us").over(W.partitionBy("feed_id")).alias("last_us"),
        )
    else:
        polls = polls.withColumn("__chunk", F.floor(F.col("snapshot_seq") / _SEQ_CHUNK))
        part = ["feed_id", "__chunk"]
        across = W.partitionBy("feed_id").orderBy("__chunk")
        edges = (
            polls.groupBy(*part)
            .agg(
                F.count(F.lit(1)).alias("__n"),
                F.min_by(at, "snapshot_seq").alias("__first"),
                F.max_by(at, "snapshot_seq").alias("__last"),
            )
            .select(
                *part,
                F.coalesce(
                    F.sum("__n").over(across.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
                ).alias("__base"),
                F.lag("__last").over(across).alias("__before"),
                F.lead("__first").over(across).alias("__after"),
                F.max(F.col("__last.us")).over(W.partitionBy("feed_id")).alias("last_us"),
            )
        )
        w = W.partitionBy(*part).orderBy("snapshot_seq")
        linked = (
            polls.select(
                "*",
                F.row_number().over(w).alias("__at"),
                F.lag("now_us").over(w).alias("__prev_us"),
                F.lead(at).over(w).alias("__lead"),
            )
            .join(edges, part)
            .withColumn("k", F.col("__base") + F.col("__at") - 1)
            .withColumn("prev_us", F.coalesce("__prev_us", "__before.us"))
            .withColumn("__next", F.coalesce("__lead", "__after"))
        )
    return linked.select(
        "feed_id",
        "snapshot_seq",
        "state_retention_days",
        "now_us",
        "k",
        "prev_us",
        F.col("__next.us").alias("next_us"),
        F.col("__next.seq").alias("next_seq"),
        "last_us",
    )


def neighbours(rows: DataFrame, chunked: bool) -> DataFrame:
    """Attach ``lag`` and ``lead``: structs of the key's previous and next observation."""
    # What is asked of the previous and of the next observation.
    before, after = F.struct("k", "hash", "start_us", "next_us"), F.struct("k", "prev_us")
    key = ["feed_id", "uid"]
    if not chunked:
        w = W.partitionBy(*key).orderBy("k")
        return rows.select("*", F.lag(before).over(w).alias("lag"), F.lead(after).over(w).alias("lead"))
    rows = rows.withColumn("__chunk", F.floor(F.col("k") / CHUNK))
    part = [*key, "__chunk"]
    inside = W.partitionBy(*part).orderBy("k")
    across = W.partitionBy(*key).orderBy("__chunk")
    edges = (
        rows.groupBy(*part)
        .agg(F.min_by(after, F.col("k")).alias("__first"), F.max_by(before, F.col("k")).alias("__last"))
        .select(
            *part,
            F.lag("__last").over(across).alias("__before"),
            F.lead("__first").over(across).alias("__after"),
        )
    )
    return (
        rows.select(
            "*", F.lag(before).over(inside).alias("lag"), F.lead(after).over(inside).alias("lead")
        )
        .join(edges, part)
        .withColumn("lag", F.coalesce("lag", "__before"))
        .withColumn("lead", F.coalesce("lead", "__after"))
        .drop("__chunk", "__before", "__after")
    )


def first_snapshot_after(line: DataFrame) -> DataFrame:
    """Lookup per feed and day: the snapshots of the first day from it on that has any, and the one after.

    ``polls`` holds the snapshots of one day, so it is as long as a feed is polled per day.
    """
    by_day = line.groupBy("feed_id", F.floor(F.col("now_us") / DAY_US).alias("__day")).agg(
        F.sort_array(F.collect_list(F.struct("now_us", "k", "snapshot_seq"))).alias("polls")
    )
    w = W.partitionBy("feed_id").orderBy("__day")
    first_day = F.coalesce(F.lag("__day").over(w) + 1, F.col("__day"))
    return (
        by_day.withColumn("__from", first_day)
        .withColumn("later", F.lead(F.col("polls")[0]).over(w))
        .withColumn("day", F.explode(F.sequence("__from", "__day")))
        .select("feed_id", "day", "polls", "later")
    )


def replay(
    observations: DataFrame,
    timeline: DataFrame,
    small: bool | None = None,
    chunked: bool | None = None,
) -> DataFrame:
    """Action of every key at every snapshot: feed_id, snapshot_seq, uid, action.

    ``observations`` has one row per (feed_id, snapshot_seq, uid) with hash and start. Retained keys
    have no row, as they need no work.

    A key absent from the next snapshot is deleted there if it is still ahead. If it has aired it is
    never deleted, but pruned at the first absent snapshot past its retention, if there is one.

    ``small`` (the timeline is broadcast) and ``chunked`` (histories are cut) follow from a bounded count
    of the timeline unless given; they change the plan, not the result.
    """
    if chunked is None or small is None:
        polls = timeline.limit(BROADCAST_ROWS + 1).count()
        small = polls <= BROADCAST_ROWS if small is None else small
        chunked = polls > CHUNK if chunked is None else chunked
    line = dense_timeline(timeline, small)
    rows = attach(
        observations.select(
            "feed_id", "snapshot_seq", "uid", "hash", F.unix_micros("start").alias("start_us")
        ),
        line,
        keys=("feed_id", "snapshot_seq"),
        small=small,
    )
    linked = neighbours(rows, chunked)

    retention_us = at_most_longest(F.col("state_retention_days").cast("bigint"), 1) * DAY_US
    cutoff = F.col("start_us") + retention_us

    def ended(absent: Column, start: Column, next_us: Column, last_absent_us: Column) -> Column:
        """Whether an absence took the key out of state."""
        forgotten = last_absent_us - retention_us > start
        return absent & ((start > next_us) | forgotten)

    lag, lead = F.col("lag"), F.col("lead")
    came_back_new = F.coalesce(
        ended(lag.k < F.col("k") - 1, lag.start_us, lag.next_us, F.col("prev_us")), F.lit(False)
    )
    own = (
        F.when(lag.isNull() | came_back_new, "create")
        .when(lag.hash != F.col("hash"), "update")
        .otherwise("unchanged")
    )
    absent_next = F.col("next_us").isNotNull() & (lead.isNull() | (lead.k > F.col("k") + 1))
    last_absent_us = F.when(lead.isNull(), F.col("last_us")).otherwise(lead.prev_us)
    deleted = absent_next & (F.col("start_us") > F.col("next_us"))
    pruned = absent_next & ~deleted & (last_absent_us > cutoff)
    next_seq = F.col("next_seq").alias("snapshot_seq")
    decided = linked.select(
        "feed_id",
        "uid",
        "k",
        "next_us",
        "next_seq",
        cutoff.alias("cutoff_us"),
        F.filter(
            F.array(
                F.struct(own.alias("action"), F.col("snapshot_seq").alias("snapshot_seq")),
                F.when(deleted, F.struct(F.lit("delete").alias("action"), next_seq)),
                F.when(pruned, F.struct(F.lit("prune").alias("action"), next_seq)),
            ),
            lambda x: x.isNotNull(),
        ).alias("__acts"),
    )
    acts = decided.withColumn("__act", F.explode("__acts")).select(
        "feed_id", "uid", "k", "next_us", "next_seq", "cutoff_us", "__act.action", "__act.snapshot_seq"
    )
    # The day of the lookup: not before the next snapshot's, which is the earliest that can prune.
    day = F.when(
        F.col("action") == "prune",
        F.greatest(F.floor(F.col("cutoff_us") / DAY_US), F.floor(F.col("next_us") / DAY_US)),
    )
    looked_up = attach(
        acts.withColumn("day", day),
        first_snapshot_after(line),
        keys=("feed_id", "day"),
        how="left",
        small=small,
        count_hot=False,
    )
    after = F.filter("polls", lambda p: p.now_us > F.col("cutoff_us"))
    hit = F.coalesce(F.get(after, F.lit(0)), F.col("later"))
    at = (
        F.when(F.col("action") != "prune", F.col("snapshot_seq"))
        .when(hit.k <= F.col("k"), F.col("next_seq"))
        .otherwise(hit.snapshot_seq)
    )
    return looked_up.select("feed_id", at.alias("snapshot_seq"), "uid", "action")
