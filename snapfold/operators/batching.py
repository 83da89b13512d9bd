"""Operations: order, numbering, batches, payloads and request rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapfold.functions.text import percent_encode, truncate
from snapfold.functions.zones import format_day, format_wall
from snapfold.operators.spread import attach, digest_bucket, position_within

# Limits and constants of the receiving service.
BATCH_SIZE = 20
MAX_SUBJECT = 255
MAX_BODY = 8000
KIND_RANK = {"create": 0, "update": 1, "delete": 2}
METHOD = {"create": "POST", "update": "PATCH", "delete": "DELETE"}

_CHUNK = 65_536


def operations(actions: DataFrame) -> DataFrame:
    """The actions that need a write, with ``kind``; deletes have no event columns."""
    return (
        actions.where(F.col("action").isin(*KIND_RANK))
        .withColumnRenamed("action", "kind")
        .drop("stored_hash", "stored_start")
    )


def kind_rank(kind: Column) -> Column:
    rank = F.lit(None).cast("int")
    for name, value in KIND_RANK.items():
        rank = F.when(kind == name, value).otherwise(rank)
    return rank


def number_ops(ops: DataFrame) -> DataFrame:
    """``op_ord`` per feed: creates, then updates, then deletes, so that a rename leaves no gap.

    Creates and updates keep feed order. Deletes have no order of their own; they are ordered by a
    digest bucket of the uid and the uid, which numbers them evenly spread.
    """
    rank = kind_rank(F.col("kind"))
    place = F.coalesce(F.col("feed_ord"), digest_bucket(F.col("uid")) * _CHUNK)
    chunk = rank.cast("bigint") * (1 << 50) + F.floor(place / _CHUNK)
    ordered = ops.withColumn("__place", place).withColumn("__chunk", chunk)
    return position_within(ordered, ["feed_id"], "__chunk", ["__place", "uid"], "op_ord").drop(
        "__place", "__chunk"
    )


def assign_batches(ops: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Consecutive groups of ``size`` operations; the last one of a feed may be short."""
    return ops.withColumn("batch_id", F.floor(F.col("op_ord") / size)).withColumn(
        "id", F.concat(F.lit("op-"), F.col("op_ord").cast("string"))
    )


def dispatch_counts(ops: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Requests and batches per feed."""
    return ops.groupBy("feed_id").agg(
        F.count(F.lit(1)).alias("requests"), F.ceil(F.count(F.lit(1)) / size).alias("batches")
    )


def body_content(description: Column, url: Column) -> Column:
    """Description, then the URL unless the description already holds it."""
    described = F.coalesce(F.contains(description, url), F.lit(False))
    return F.concat_ws(
        "\n\n",
        F.nullif(description, F.lit("")),
        F.when(~described, F.nullif(url, F.lit(""))),
    )


def boundary(instant: Column, is_all_day: Column, zone: Column) -> Column:
    """STRUCT<dateTime, timeZone>: the UTC day of an all-day event, else wall time in the zone."""
    shown = F.when(is_all_day, format_day(instant)).otherwise(format_wall(instant, zone))
    return F.struct(shown.alias("dateTime"), zone.alias("timeZone"))


def payload(zone: Column, category: Column) -> Column:
    """Create payload of the event columns of a row; an update drops ``transactionId``."""
    part = F.col
    return F.struct(
        truncate(part("summary"), MAX_SUBJECT).alias("subject"),
        F.struct(
            F.lit("text").alias("contentType"),
            truncate(body_content(part("description"), part("url")), MAX_BODY).alias("content"),
        ).alias("body"),
        boundary(part("start"), part("is_all_day"), zone).alias("start"),
        boundary(part("end"), part("is_all_day"), zone).alias("end"),
        part("is_all_day").alias("isAllDay"),
        F.lit("free").alias("showAs"),
        F.lit(False).alias("isReminderOn"),
        F.array(category).alias("categories"),
        part("hash").alias("transactionId"),
    )


def outbox(
    batched: DataFrame, targets: DataFrame, run_seq: int, small: bool | None = None
) -> DataFrame:
    """Request rows: ``id, method, url, body`` plus the key columns.

    ``targets`` has one row per feed: target_upn, calendar_id, display_tz, event_category.
    """
    joined = attach(batched, targets, how="inner", small=small)
    kind = F.col("kind")
    user = F.concat(F.lit("/users/"), percent_encode(F.col("target_upn")))
    collection = F.concat(
        user, F.lit("/calendars/"), percent_encode(F.col("calendar_id")), F.lit("/events")
    )
    item = F.concat(user, F.lit("/events/"), percent_encode(F.col("event_id")))
    full = payload(F.col("display_tz"), F.col("event_category"))
    body = F.when(kind == "create", F.to_json(full)).when(
        kind == "update", F.to_json(full.dropFields("transactionId"))
    )
    method = F.lit(None).cast("string")
    for name, verb in METHOD.items():
        method = F.when(kind == name, verb).otherwise(method)
    return joined.select(
        F.lit(run_seq).cast("bigint").alias("run_seq"),
        "feed_id",
        "batch_id",
        "op_ord",
        "id",
        "uid",
        "kind",
        method.alias("method"),
        F.when(kind == "create", collection).otherwise(item).alias("url"),
        body.alias("body"),
    )
