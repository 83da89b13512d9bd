"""Registration of queries, and the inputs and SQL fragments they share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapfold.functions.digest import with_hash
from snapfold.functions.zones import iso_ms
from snapfold.operators.decode import last_wins
from snapfold.operators.reconcile import reconcile
from snapfold.session import configure, scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` gives the same rows over the same tables."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[name] = call
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_number(col: str | Column) -> Column:
    """Digits of the first number in a text; props is ``{"k": n}``."""
    return F.regexp_extract(col, "[0-9]+", 0)


# Every event as a feed event: the feed is the event type, the key is a user and a digit of the props.
EV = """
ev AS (
  SELECT event_type AS feed_id,
         CAST(user_id AS VARCHAR) || '-' || substr(regexp_extract(props, '[0-9]+'), 1, 1) AS uid,
         event_id AS feed_ord,
         event_type || ' ' || props AS summary,
         CASE WHEN value >= 50 THEN 'value, ' || props END AS description,
         'https://feeds.example.org/' || event_type || '?u=' || user_id AS url,
         ts AS "start", ts + INTERVAL 30 MINUTE AS "end"
  FROM events)
"""


def iso_sql(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


def hash_sql(all_day: str = "'false'") -> str:
    start, end = iso_sql('"start"'), iso_sql('"end"')
    return (
        "sha256(summary || '|' || coalesce(description, '') || '|' || coalesce(url, '') || '|' || "
        f"{start} || '|' || {end} || '|' || {all_day})"
    )


def feed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    start = F.col("ts").cast("timestamp")
    user = F.col("user_id").cast("string")
    return e.select(
        F.col("event_type").alias("feed_id"),
        F.lit(1).cast("bigint").alias("snapshot_seq"),
        F.concat(user, F.lit("-"), F.substring(first_number("props"), 1, 1)).alias("uid"),
        F.col("event_id").alias("feed_ord"),
        F.concat_ws(" ", "event_type", "props").alias("summary"),
        F.when(F.col("value") >= 50, F.concat(F.lit("value, "), "props")).alias("description"),
        F.concat(F.lit("https://feeds.example.org/"), "event_type", F.lit("?u="), user).alias("url"),
        start.alias("start"),
        (start + F.expr("INTERVAL 30 MINUTES")).alias("end"),
        F.lit(False).alias("is_all_day"),
    )


# A rolling window: the state was written from everything before WRITTEN_UP_TO, the feed now shows
# everything from WINDOW_FROM on, and the clock stands at NOW.
NOW = "2024-01-12 00:00:00"
WINDOW_FROM = "2024-01-16 00:00:00"
WRITTEN_UP_TO = "2024-01-23 00:00:00"
RETENTION_DAYS = 5

SIDES = f"""
{EV},
stored AS (
  SELECT feed_id, uid, 'id-' || uid AS event_id, {hash_sql()} AS hash, {iso_sql('"start"')} AS "start",
         date_trunc('milliseconds', "start") AS starts_at
  FROM ev WHERE "start" < TIMESTAMP '{WRITTEN_UP_TO}'
  QUALIFY row_number() OVER (PARTITION BY feed_id, uid ORDER BY feed_ord DESC) = 1),
fresh AS (
  SELECT feed_id, uid, min(feed_ord) OVER (PARTITION BY feed_id, uid) AS feed_ord, summary, description,
         url, "start", "end", {hash_sql()} AS hash
  FROM ev WHERE "start" >= TIMESTAMP '{WINDOW_FROM}'
  QUALIFY row_number() OVER (PARTITION BY feed_id, uid ORDER BY ev.feed_ord DESC) = 1)
"""

ACTIONS = f"""
{SIDES},
actions AS (
  SELECT coalesce(f.feed_id, s.feed_id) AS feed_id, coalesce(f.uid, s.uid) AS uid,
         s.event_id, s.hash AS stored_hash, s."start" AS stored_start, f.hash, f."start", f."end",
         f.feed_ord, f.summary, f.description, f.url,
         CASE WHEN s.uid IS NULL THEN 'create'
              WHEN f.uid IS NOT NULL AND f.hash <> s.hash THEN 'update'
              WHEN f.uid IS NOT NULL THEN 'unchanged'
              WHEN s.starts_at > TIMESTAMP '{NOW}' THEN 'delete'
              WHEN s.starts_at < TIMESTAMP '{NOW}' - INTERVAL {RETENTION_DAYS} DAY THEN 'prune'
              ELSE 'retain' END AS action
  FROM fresh f FULL JOIN stored s ON f.feed_id = s.feed_id AND f.uid = s.uid)
"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(feed events, stored state) of the rolling window."""
    ev = feed_events(spark, sf_dir)
    old = ev.where(F.col("start") < F.lit(WRITTEN_UP_TO).cast("timestamp"))
    stored = with_hash(last_wins(old, ("feed_id", "uid"))).select(
        "feed_id",
        "uid",
        F.concat(F.lit("id-"), "uid").alias("event_id"),
        "hash",
        iso_ms(F.col("start")).alias("start"),
    )
    shown = ev.where(F.col("start") >= F.lit(WINDOW_FROM).cast("timestamp"))
    return with_hash(last_wins(shown, ("feed_id", "uid"))), stored


def all_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("feed_id")).distinct()


def run_clock(feeds: DataFrame) -> DataFrame:
    return feeds.select(
        "feed_id",
        F.lit(NOW).cast("timestamp").alias("now"),
        F.lit(RETENTION_DAYS).alias("state_retention_days"),
    )


def window_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh, stored = sides(spark, sf_dir)
    return reconcile(fresh, stored, run_clock(all_feeds(spark, sf_dir)))


def written(df: DataFrame) -> DataFrame:
    """Write a frame that several branches read to a folder of its own in the shared scratch folder."""
    folder = f"{scratch_dir(df.sparkSession)}/snapfold-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


# Response statuses of the n-th attempt for an operation, from one hex digit of a digest of its key.
STATUS_OF_DIGIT = {"a": 429, "b": 503, "c": 500, "e": 404, "f": 409}


def status_digit(n: int) -> Column:
    return F.substring(F.md5(F.concat("feed_id", F.lit("/"), "uid")), n, 1)


def status_column(n: int) -> Column:
    """Status of an attempt; digit d means that the response is missing."""
    digit = status_digit(n)
    status = F.lit(200)
    for letter, code in STATUS_OF_DIGIT.items():
        status = F.when(digit == letter, code).otherwise(status)
    return F.when(digit != "d", status)


def status_sql(n: int) -> str:
    digit = f"substr(md5(feed_id || '/' || uid), {n}, 1)"
    whens = " ".join(f"WHEN '{d}' THEN {s}" for d, s in STATUS_OF_DIGIT.items())
    return f"(CASE {digit} WHEN 'd' THEN NULL {whens} ELSE 200 END)"
