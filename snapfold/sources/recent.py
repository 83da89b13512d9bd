"""The log of recent additions: appended per run, read as a capped view."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from snapfold.functions.jsons import is_object_text, members, number_at, parse, string_at

# Default size of the view, version that is read.
DEFAULT_PAGE = 100
RECENT_VERSION = 1

# Tasks that one feed's log is ranked in at first.
SALTS = 32

FIELDS = ("uid", "summary", "start", "addedAt", "eventId")


def revive_recent(raw: DataFrame) -> DataFrame:
    """Entries of a stored JSON log (column ``json``), in stored order ``ord``; malformed ones dropped."""
    v = F.col("__v")
    version_ok = F.coalesce(number_at(v, "$.version") == RECENT_VERSION, F.lit(False))
    keys = [c for c in raw.columns if c != "json"]
    logs = (
        raw.withColumn("__v", parse(F.col("json")))
        .where(is_object_text(F.col("json")) & version_ok)
        .select(*keys, F.try_variant_get("__v", "$.entries", "variant").alias("__entries"))
    )
    e = F.col("value")
    read = (
        members(logs, "__entries")
        .where(F.col("key").isNull() & F.col("pos").isNotNull())
        .select(
            *keys,
            *[string_at(e, f"$.{name}").alias(name) for name in FIELDS],
            F.coalesce(string_at(e, "$.feedId"), F.lit("unknown")).alias("feed_id"),
            F.col("pos").cast("bigint").alias("ord"),
        )
    )
    return read.dropna(subset=list(FIELDS)).withColumnsRenamed(
        {"addedAt": "added_at", "eventId": "event_id"}
    )


def write_recent(additions: DataFrame, path: str, run_seq: int) -> None:
    """Write a run's additions. Repeating a run replaces what an earlier try wrote, also by nothing."""
    additions.write.mode("overwrite").parquet(f"{path}/run_seq={run_seq}")


def newest_first() -> list[Column]:
    """Newest run first; inside a run the later start first, ties in order of arrival."""
    return [F.desc("run_seq"), F.desc("start"), F.asc("feed_id"), F.asc("ord"), F.asc("uid")]


def recent(log: DataFrame, limit: int = DEFAULT_PAGE) -> DataFrame:
    """The newest entries across all feeds (one at least), taken by a top-N without a full sort."""
    return log.orderBy(*newest_first()).limit(max(limit, 1))


def recent_by_feed(log: DataFrame, feeds: DataFrame) -> DataFrame:
    """The newest ``recent_limit`` entries (one at least) of each registered feed.

    Ranked in salted parts of a feed first, so that no task gets the whole log of a large feed.
    """
    limits = feeds.select("feed_id", F.greatest("recent_limit", F.lit(1)).alias("__limit"))
    rows = log.join(limits, "feed_id").withColumn("__salt", F.pmod(F.xxhash64("run_seq", "uid"), F.lit(SALTS)))
    for keys in (["feed_id", "__salt"], ["feed_id"]):
        place = F.row_number().over(W.partitionBy(*keys).orderBy(*newest_first()))
        rows = rows.withColumn("__place", place).where("__place <= __limit")
    return rows.select(*log.columns)


def page_size(requested: str | None, configured: int = DEFAULT_PAGE) -> int:
    """Entries of a page: the configured number if none is asked for, 100 for a request that is not a
    positive number."""
    text = str(configured) if requested is None else requested.strip()
    decimal = re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text, re.ASCII)
    number = float(text) if decimal else 0.0
    return int(number if number > 0 else DEFAULT_PAGE)


def recent_page(log: DataFrame, requested: str | None, configured: int = DEFAULT_PAGE) -> DataFrame:
    """A page of the view with ``count``, the size of the whole view and not of the page."""
    whole_view = W.partitionBy(F.lit(0))
    view = recent(log, configured).withColumn("count", F.count(F.lit(1)).over(whole_view))
    return view.orderBy(*newest_first()).limit(page_size(requested, configured))
