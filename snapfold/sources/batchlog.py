"""Outbox and response tables, the contract with whatever applies the operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapfold.functions.jsons import members, number_at, parse, string_at


def write_outbox(requests: DataFrame, path: str, run_seq: int) -> str:
    """Write a run's requests; repeating a run replaces its folder, so each request exists once."""
    folder = f"{path}/run_seq={run_seq}"
    # In order within a batch, which is what is applied as one; batches are independent of each other.
    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = requests.drop("run_seq").repartition(n, "feed_id", "batch_id")
    dealt.sortWithinPartitions("feed_id", "op_ord").write.mode("overwrite").parquet(folder)
    return folder


def read_responses(raw: DataFrame) -> DataFrame:
    """Response rows of logged batch replies (run_seq, feed_id, batch_id, attempt, json).

    Entries whose id is not a string or whose status is not a number that fits are ignored; an absent body
    is NULL. The last entry of an id that a reply repeats counts. A reply is one batch, at most a few dozen
    entries.
    """
    keys = [c for c in raw.columns if c != "json"]
    replies = raw.withColumn("__v", parse(F.col("json"))).select(
        *keys, F.try_variant_get("__v", "$.responses", "variant").alias("__responses")
    )
    r = F.col("value")
    body = F.try_variant_get(r, "$.body", "variant")
    retry_after = F.try_variant_get(r, '$.headers["Retry-After"]', "string")
    found = (
        members(replies, "__responses")
        .where(F.col("key").isNull())
        .select(
            *keys,
            "pos",
            string_at(r, "$.id").alias("id"),
            number_at(r, "$.status").try_cast("int").alias("status"),
            F.when(~F.is_variant_null(body), F.to_json(body)).alias("body"),
            retry_after.alias("retry_after"),
        )
        .where(F.col("id").isNotNull() & F.col("status").isNotNull())
    )
    last = F.max_by(F.struct("status", "body", "retry_after"), F.col("pos"))
    return found.groupBy(*keys, "id").agg(last.alias("__last")).select(*keys, "id", "__last.*")
