"""State tables: a base and the changes of later runs, found through a commit record that is written last."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapfold import schemas
from snapfold.functions.jsons import is_object_text, members, number_at, parse, string_at
from snapfold.functions.zones import parse_iso

# Fixed value: the only schema version that is read.
STATE_VERSION = 1


def _usable(parsed: Column) -> Column:
    """A stored object of the version that is read."""
    version_ok = F.coalesce(number_at(parsed, "$.version") == STATE_VERSION, F.lit(False))
    return is_object_text(F.col("json")) & version_ok


def revive_headers(raw: DataFrame) -> DataFrame:
    """Headers of stored JSON blobs (feed_id, json): version, calendar_id, last_sync_at, was_reset.

    Text that is not an object, or another version, resets the whole feed. A bad calendar id is NULL, a
    bad time is the epoch.
    """
    v, usable = F.col("__v"), F.col("__usable")
    epoch = F.timestamp_seconds(F.lit(0))
    synced = parse_iso(string_at(v, "$.lastSyncAt"))
    return (
        raw.withColumn("__v", parse(F.col("json")))
        .withColumn("__usable", _usable(v))
        .select(
            "feed_id",
            F.lit(STATE_VERSION).alias("version"),
            F.when(usable, F.nullif(string_at(v, "$.calendarId"), F.lit(""))).alias("calendar_id"),
            F.when(usable, F.coalesce(synced, epoch)).otherwise(epoch).alias("last_sync_at"),
            (~usable).alias("was_reset"),
        )
    )


def revive_entries(raw: DataFrame) -> DataFrame:
    """Entries of stored JSON blobs, one row per uid, with ``dropped`` for the malformed ones.

    Every entry is read on its own, so one that is broken costs one row and not the feed.
    """
    stored = (
        raw.withColumn("__v", parse(F.col("json")))
        .where(_usable(F.col("__v")))
        .select("feed_id", F.try_variant_get("__v", "$.events", "variant").alias("__events"))
    )
    e = F.col("value")
    read = (
        members(stored, "__events")
        .where(F.col("key").isNotNull())
        .select(
            "feed_id",
            F.col("key").alias("uid"),
            F.nullif(string_at(e, "$.eventId"), F.lit("")).alias("event_id"),
            F.nullif(string_at(e, "$.hash"), F.lit("")).alias("hash"),
            string_at(e, "$.start").alias("start"),
        )
    )
    complete = (
        (F.col("uid") != "")
        & F.col("event_id").isNotNull()
        & F.col("hash").isNotNull()
        & parse_iso(F.col("start")).isNotNull()
    )
    return read.withColumn("dropped", ~F.coalesce(complete, F.lit(False)))


def revive_state(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state, headers, dropped counts per feed) of stored JSON blobs."""
    entries = revive_entries(raw)
    state = entries.where(~F.col("dropped")).drop("dropped")
    counts = entries.groupBy("feed_id").agg(F.count_if("dropped").alias("dropped"))
    return state, revive_headers(raw), counts


def write_keyed(
    spark: SparkSession, df: DataFrame, path: str, run_seq: int, buckets: int, parts: tuple[str, ...] = ()
) -> DataFrame:
    """Write a run's table bucketed by (feed_id, uid), in folders by ``parts``, and return it.

    The next join on the key then reads it without a shuffle. A frame that comes out of such a join is
    already partitioned alike, so it is written without one too. ``buckets`` should give files of about
    100 to 500 MB.
    """
    name = table_name(path, run_seq)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    (
        df.write.mode("overwrite")
        .format("parquet")
        .option("path", f"{path}/run_seq={run_seq}")
        .partitionBy(*parts)
        .bucketBy(buckets, "feed_id", "uid")
        .sortBy("feed_id", "uid")
        .saveAsTable(name)
    )
    return spark.table(name)


def register_keyed(
    spark: SparkSession, path: str, run_seq: int, schema: str, buckets: int, parts: tuple[str, ...] = ()
) -> str:
    """Catalog name of a keyed table, declared again in a session that did not write it."""
    name = table_name(path, run_seq)
    if not spark.catalog.tableExists(name):
        by = f"PARTITIONED BY ({', '.join(parts)}) " if parts else ""
        spark.sql(
            f"CREATE TABLE {name} ({schema}) USING parquet {by}"
            f"CLUSTERED BY (feed_id, uid) SORTED BY (feed_id, uid) INTO {buckets} BUCKETS "
            f"LOCATION '{path}/run_seq={run_seq}'"
        )
        if parts:
            spark.sql(f"MSCK REPAIR TABLE {name}")
    return name


@dataclass(frozen=True)
class Layout:
    """Where a state is and how it is laid out: a base, and the runs whose changes come on top of it.

    The folders of base and changes are by ``feed_bucket``, a hash of the feed, so that a run reads those of
    its feeds only; the base is bucketed by key within them, so that a feed of any size is spread.
    """

    base: int | None
    log: tuple[int, ...]
    buckets: int
    feed_buckets: int


def feed_bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("feed_id"), F.lit(buckets)).cast("int")


def wanted_buckets(feeds: DataFrame, layout: Layout) -> list[int]:
    """Feed buckets of the given feeds; at most as many numbers as there are buckets."""
    return [r[0] for r in feeds.select(feed_bucket(layout.feed_buckets)).distinct().collect()]


def write_changes(settled: DataFrame, path: str, run_seq: int, feed_buckets: int) -> bool:
    """Write the rows of ``settled`` that have an effect as a run's part of the change log; whether there are any.

    The files follow the amount of changes: small feed buckets share a task, large ones are split.
    """
    folder = f"{path}/run_seq={run_seq}"
    changed = settled.where(F.col("effect") != "keep").select("feed_id", "uid", "effect", "next.*")
    (
        changed.withColumn("feed_bucket", feed_bucket(feed_buckets))
        .hint("rebalance", "feed_bucket")
        .write.mode("overwrite")
        .partitionBy("feed_bucket")
        .parquet(folder)
    )
    return not settled.sparkSession.read.schema(schemas.STATE_LOG).parquet(folder).isEmpty()


def write_base(state: DataFrame, path: str, run_seq: int, layout: Layout) -> None:
    """Write a whole state as a base."""
    rows = state.withColumn("feed_bucket", feed_bucket(layout.feed_buckets))
    write_keyed(state.sparkSession, rows, path, run_seq, layout.buckets, ("feed_bucket",))


def read_state(
    spark: SparkSession, base_path: str, log_path: str, layout: Layout | None, wanted: list[int] | None = None
) -> DataFrame:
    """The state of a layout: the newest change of a key, else its row of the base.

    ``wanted`` restricts it to some feed buckets; folders of others are not read. The base does not move:
    only the changes are shuffled.
    """
    if layout is None:
        return spark.createDataFrame([], schemas.STATE)

    def pruned(df: DataFrame) -> DataFrame:
        return df if wanted is None else df.where(F.col("feed_bucket").isin(wanted))

    state = spark.createDataFrame([], schemas.STATE)
    if layout.base is not None:
        base = register_keyed(
            spark, base_path, layout.base, schemas.STATE + ", feed_bucket int", layout.buckets, ("feed_bucket",)
        )
        state = pruned(spark.table(base)).drop("feed_bucket")
    if not layout.log:
        return state
    log = (
        spark.read.schema(schemas.STATE_LOG)
        .option("basePath", log_path)
        .parquet(*(f"{log_path}/run_seq={r}" for r in layout.log))
    )
    newest = newest_changes(pruned(log))
    kept = state.join(newest.select("feed_id", "uid"), ["feed_id", "uid"], "left_anti")
    return kept.unionByName(newest.where("effect = 'put'").drop("effect"))


def newest_changes(log: DataFrame) -> DataFrame:
    """The last change of each key, whatever the number of runs."""
    last = F.max_by(F.struct("effect", "event_id", "hash", "start"), "run_seq").alias("__last")
    return log.groupBy("feed_id", "uid").agg(last).select("feed_id", "uid", "__last.*")


def table_name(path: str, run_seq: int) -> str:
    """Catalog name of a run's table; the folder's digest keeps different stores apart."""
    return f"snapfold_{hashlib.sha256(path.encode()).hexdigest()[:12]}_{run_seq}"
