"""Landed feed documents: ``<root>/feed_id=<id>/snapshot_seq=<n>/part-<i>-of-<n>.ics``.

One snapshot is one document, or several parts where a feed is too large for one. A snapshot counts as
fetched only when all its parts are there. Spark does not list files of no bytes, so an empty answer must
be landed as a line break to be reported as an empty feed.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from snapfold.operators.spread import KEY_ROWS, attach, fits_broadcast
from snapfold.sources.folders import exists

# Fixed value: largest document that is read.
MAX_DOCUMENT_BYTES = 8 * 1024 * 1024
# A written part ends with the event that brings it over so many bytes; an event that is larger is a part of
# its own. So a part stays below the ceiling unless a single event doesn't.
PART_BYTES = MAX_DOCUMENT_BYTES // 2 - 1024

_PART = r"/part-(\d+)-of-(\d+)\.ics$"
# The columns of Spark's binaryFile source and those of the folders, with their types fixed.
FILE_SCHEMA = (
    "path string, modificationTime timestamp, length bigint, content binary, "
    "feed_id string, snapshot_seq bigint"
)


def part_number(path: Column) -> Column:
    """Part that a landed file holds; NULL if its name is not that of a part."""
    number = [F.regexp_extract(path, _PART, i).try_cast("bigint") for i in (1, 2)]
    return F.when(number[1].isNotNull(), number[0])


def named(files: DataFrame) -> DataFrame:
    """Documents of landed files; the part numbers come from the file name."""

    def group(i: int) -> Column:
        return F.regexp_extract("path", _PART, i).try_cast("bigint")

    # A number that does not fit is no part number.
    return files.where(group(1).isNotNull() & group(2).isNotNull()).select(
        "feed_id",
        "snapshot_seq",
        F.col("modificationTime").alias("snapshot_ts"),
        group(1).alias("part"),
        group(2).alias("parts"),
        "length",
        "content",
    )


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Documents below a landing folder; only the files' metadata is read until content is used.

    Feed and snapshot are folder columns, so a join that picks snapshots skips the other folders.
    """
    files = (
        spark.read.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("pathGlobFilter", "*.ics")
        .load(path)
    )
    return named(files)


def read_folders(spark: SparkSession, path: str, keys: list[tuple[str, int]]) -> DataFrame:
    """Documents of some snapshots' folders, those that are still there; no other folder is listed."""
    folders = [f"{path}/feed_id={feed}/snapshot_seq={seq}" for feed, seq in keys]
    folders = [x for x in folders if exists(spark, x)]
    if not folders:
        return named(spark.createDataFrame([], FILE_SCHEMA))
    files = (
        spark.read.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("basePath", path)
        .option("pathGlobFilter", "*.ics")
        .load(folders)
    )
    return named(files)


def polls(documents: DataFrame) -> DataFrame:
    """One row per snapshot: the time its last part arrived and the number of parts it should have."""
    return documents.groupBy("feed_id", "snapshot_seq").agg(
        F.max("snapshot_ts").alias("snapshot_ts"), F.max("parts").alias("parts")
    )


def silent_feeds(
    documents: DataFrame, feeds: DataFrame, now: dt.datetime, max_age: dt.timedelta
) -> DataFrame:
    """(feed_id) of the registered feeds that landed nothing since ``now - max_age``, or nothing ever."""
    newest = documents.groupBy("feed_id").agg(F.max("snapshot_ts").alias("newest"))
    oldest = F.lit(now - max_age).cast("timestamp")
    landed = feeds.select("feed_id").join(newest, "feed_id", "left")
    return landed.where(F.col("newest").isNull() | (F.col("newest") < oldest)).select("feed_id")


def admit(documents: DataFrame, max_bytes: int = MAX_DOCUMENT_BYTES) -> DataFrame:
    """Documents within the size ceiling; the test is on the length, before any content is read."""
    return documents.where(F.col("length") <= max_bytes)


def warn_content_type(content_type: Column) -> Column:
    """Whether a content type hints that something other than the feed answered; not a reason to reject."""
    expected = r"(?i)text/calendar|text/plain|application/octet-stream"
    given = F.coalesce(content_type, F.lit(""))
    return (given != "") & ~given.rlike(expected)


def newest_keys(documents: DataFrame, feed_state: DataFrame, feeds: DataFrame) -> DataFrame:
    """(feed_id, snapshot_seq) of each registered feed's newest snapshot, if it is not applied yet."""
    newest = documents.groupBy("feed_id").agg(F.max("snapshot_seq").alias("snapshot_seq"))
    applied = feed_state.select("feed_id", "applied_snapshot_seq")
    return (
        newest.join(feeds.select("feed_id"), "feed_id", "left_semi")
        .join(applied, "feed_id", "left")
        .where(F.col("snapshot_seq") > F.coalesce("applied_snapshot_seq", F.lit(-1)))
        .select("feed_id", "snapshot_seq")
    )


def newest_per_feed(documents: DataFrame, feed_state: DataFrame, feeds: DataFrame) -> DataFrame:
    """Parts of the newest snapshot per feed.

    The choice is made on the keys alone; the contents are not shuffled for it.
    """
    wanted = newest_keys(documents, feed_state, feeds)
    small = fits_broadcast(wanted, KEY_ROWS)
    return attach(documents, wanted, ("feed_id", "snapshot_seq"), "left_semi", ("part",), small)


def ics_parts(events: DataFrame, per_part: int = 10_000, part_bytes: int = PART_BYTES) -> DataFrame:
    """Render events as documents: feed_id, snapshot_seq, part, parts, text.

    The events of a feed are cut by ``feed_ord`` into chunks of at most ``per_part``, and a chunk into as many
    documents as its bytes ask for, so a large feed becomes many parts instead of one row that grows with it.
    """
    key = ["feed_id", "snapshot_seq"]
    chunk = [*key, "__cut"]
    texts = events.select(
        *key,
        F.floor(F.col("feed_ord") / per_part).alias("__cut"),
        "feed_ord",
        vevent_text().alias("text"),
    )
    before = W.partitionBy(*chunk).orderBy("feed_ord").rowsBetween(W.unboundedPreceding, -1)
    size = F.octet_length("text") + 2
    large = F.when(size > part_bytes, F.lit(1)).otherwise(F.lit(0))
    running = F.coalesce(F.sum(size).over(before), F.lit(0))
    # Odd where the event is a part of its own, one more behind it.
    alone = 2 * F.coalesce(F.sum(large).over(before), F.lit(0)) + large
    sized = texts.withColumn("__sub", F.struct(alone.alias("alone"), F.floor(running / part_bytes).alias("by_size")))
    bodies = sized.groupBy(*chunk, "__sub").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("feed_ord", "text"))), lambda e: e.text), "\r\n"
        ).alias("__body")
    )
    # Parts are numbered by a few rows per feed; no text moves for it. An event that is longer than a part
    # leaves numbers out inside its chunk, so the numbers in use are ranked.
    whole_feed = W.partitionBy(*key)
    used = sized.select(*chunk, "__sub").distinct()
    places = used.withColumns(
        {
            "part": F.row_number().over(whole_feed.orderBy("__cut", "__sub")).cast("bigint") - 1,
            "parts": F.count(F.lit(1)).over(whole_feed),
        }
    )
    return bodies.join(places, [*chunk, "__sub"]).select(
        *key,
        "part",
        "parts",
        F.concat(
            F.lit("BEGIN:VCALENDAR\r\nVERSION:2.0\r\n"), "__body", F.lit("\r\nEND:VCALENDAR\r\n")
        ).alias("text"),
    )


def escape_text(col: Column) -> Column:
    """TEXT escaping of a property value."""
    escaped = F.regexp_replace(col, r"([\\;,])", r"\\$1")
    return F.regexp_replace(escaped, r"\r\n|\n|\r", r"\\n")


def vevent_text() -> Column:
    """Minimal VEVENT of the event columns, lines joined by CRLF."""

    def stamp(col: str) -> Column:
        timed = F.concat(F.lit(":"), F.date_format(col, "yyyyMMdd'T'HHmmss'Z'"))
        day = F.concat(F.lit(";VALUE=DATE:"), F.date_format(col, "yyyyMMdd"))
        return F.when(F.col("is_all_day"), day).otherwise(timed)

    def optional(name: str, col: str) -> Column:
        return F.when(F.col(col).isNotNull(), F.concat(F.lit(name), escape_text(F.col(col))))

    return F.concat_ws(
        "\r\n",
        F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:"), escape_text(F.col("uid"))),
        F.concat(F.lit("DTSTART"), stamp("start")),
        F.concat(F.lit("DTEND"), stamp("end")),
        F.concat(F.lit("SUMMARY:"), escape_text(F.col("summary"))),
        optional("DESCRIPTION:", "description"),
        optional("URL:", "url"),
        F.lit("END:VEVENT"),
    )
