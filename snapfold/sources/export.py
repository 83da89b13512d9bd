"""State as JSON, in bounded parts: what ``revive_state`` reads, and what other tools keep per feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from snapfold.functions.zones import iso_ms
from snapfold.sources.state import STATE_VERSION

# Places that entries are dealt to, by a digest of the uid; a part is a range of them.
_PLACES = 16**6


def state_parts(state: DataFrame, headers: DataFrame, per_part: int = 10_000) -> DataFrame:
    """(feed_id, part, text): the parts of a feed's JSON, one behind the other, are its document.

    ``headers`` has feed_id, calendar_id and last_sync_at; a feed that has entries only gets an empty header. Part 0
    opens the document, the last one closes it, those between hold about ``per_part`` entries each, in the order of
    the uids' digests, so that no value grows with the feed. The same state gives the same parts.
    """
    place = F.conv(F.substring(F.sha2("uid", 256), 1, 6), 16, 10).cast("bigint")
    entry = F.struct(F.col("event_id").alias("eventId"), "hash", "start")
    member = F.to_json(F.create_map("uid", entry))
    sizes = state.groupBy("feed_id").agg(F.ceil(F.count(F.lit(1)) / per_part).alias("__parts"))
    placed = state.select(
        "feed_id", "uid", place.alias("__place"), F.substr(member, F.lit(2), F.length(member) - 2).alias("__text")
    ).join(sizes, "feed_id")
    cut = placed.withColumn("__cut", F.floor(F.col("__place") * F.col("__parts") / _PLACES))
    listed = F.sort_array(F.collect_list(F.struct("__place", "uid", "__text")))
    bodies = cut.groupBy("feed_id", "__cut").agg(F.array_join(F.transform(listed, lambda e: e["__text"]), ",").alias("text"))
    # Numbers and commas need the few parts of a feed only.
    in_feed = W.partitionBy("feed_id")
    numbers = cut.select("feed_id", "__cut").distinct().select(
        "feed_id", "__cut", F.row_number().over(in_feed.orderBy("__cut")).cast("bigint").alias("part")
    )
    middle = bodies.join(numbers, ["feed_id", "__cut"]).select(
        "feed_id", "part", F.when(F.col("part") > 1, F.concat(F.lit(","), "text")).otherwise(F.col("text")).alias("text")
    )
    used = numbers.groupBy("feed_id").agg(F.max("part").alias("__last"))
    both = headers.select("feed_id", "calendar_id", "last_sync_at").join(used, "feed_id", "full_outer")
    head = F.to_json(
        F.struct(
            F.lit(STATE_VERSION).alias("version"),
            F.col("calendar_id").alias("calendarId"),
            iso_ms(F.coalesce("last_sync_at", F.timestamp_seconds(F.lit(0)))).alias("lastSyncAt"),
        ),
        {"ignoreNullFields": "false"},
    )
    opened = F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"events":{'))
    ends = F.array(
        F.struct(F.lit(0).cast("bigint").alias("part"), opened.alias("text")),
        F.struct((F.coalesce("__last", F.lit(0)) + 1).alias("part"), F.lit("}}").alias("text")),
    )
    return both.select("feed_id", F.inline(ends)).unionByName(middle)


def write_states(parts: DataFrame, path: str) -> None:
    """Write one JSON file per feed, ``<path>/feed_id=<id>/``, part by part.

    Parts are separated by line breaks, which are blank space between members. A feed is sorted on disk and
    streamed by one task, as it is one file; no value is larger than a part.
    """
    (
        parts.repartition("feed_id")
        .sortWithinPartitions("feed_id", "part")
        .select("feed_id", "text")
        .write.mode("overwrite")
        .partitionBy("feed_id")
        .text(path)
    )


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """(feed_id, json) of written states; a feed's document has to fit one value."""
    files = spark.read.schema("value string, feed_id string").text(path, wholetext=True)
    return files.select("feed_id", F.col("value").alias("json"))
