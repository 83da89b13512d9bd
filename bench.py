"""Headline queries: median seconds of warm runs, as one JSON line.

Environment: BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS, BENCH_ALL=1 for every query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "event_digest",
    "dedupe_last_wins",
    "reconcile_summary",
    "reconcile_gated",
    "replay_history",
    "op_batches",
    "settle_attempts",
    "fold_state",
    "ics_roundtrip",
    "ics_roundtrip_documents",
    "wall_to_instant",
    "ics_dates",
    "payload_rows",
    "redact_documents",
    "recent_top_n",
]


def skew_seconds(spark, sf_dir: str, hot: bool) -> float:
    """Reconcile, number and batch line items as events of suppliers; hot puts nine tenths in one feed."""
    from pyspark.sql import functions as F
    from snapfold.functions.digest import with_hash
    from snapfold.functions.zones import iso_ms
    from snapfold.operators.batching import assign_batches, number_ops, operations
    from snapfold.operators.decode import last_wins
    from snapfold.operators.reconcile import reconcile

    key = ("feed_id", "uid")
    start = F.col("l_shipdate").cast("timestamp")
    feed = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    if hot:
        feed = F.when(F.col("l_discount") < 0.095, "hot").otherwise(feed)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        feed.alias("feed_id"),
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber").alias("uid"),
        F.col("l_orderkey").alias("feed_ord"),
        F.concat_ws(" ", "l_quantity", "l_extendedprice").alias("summary"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("url"),
        start.alias("start"),
        (start + F.expr("INTERVAL 1 HOUR")).alias("end"),
        F.lit(False).alias("is_all_day"),
    )
    fresh = with_hash(last_wins(rows.where("start >= timestamp'1997-06-01'"), key))
    stored = with_hash(last_wins(rows.where("start < timestamp'2000-01-01'"), key)).select(
        *key, F.concat(F.lit("id-"), "uid").alias("event_id"), "hash", iso_ms(F.col("start")).alias("start")
    )
    runs = rows.select("feed_id").distinct().select(
        "feed_id",
        F.lit("1997-01-01").cast("timestamp").alias("now"),
        F.lit(300).alias("state_retention_days"),
    )
    batches = assign_batches(number_ops(operations(reconcile(fresh, stored, runs))))
    taken = []
    for _ in range(3):
        started = time.perf_counter()
        batches.write.format("noop").mode("overwrite").save()
        taken.append(time.perf_counter() - started)
    return statistics.median(taken[1:])


def main() -> None:
    from pyspark import __version__
    from snapfold import local_session
    from snapfold.workloads import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    scratch = {
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-", dir="/tmp"),
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="run-", dir="/tmp"),
    }
    spark = local_session(cpus, "bench", **scratch)
    seconds, first = {}, {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - started)
        # The first run compiles the plan's code and is reported apart.
        first[name] = round(taken[0], 3)
        seconds[name] = round(statistics.median(taken[1:]), 3)
    uniform, hot = skew_seconds(spark, sf_dir, False), skew_seconds(spark, sf_dir, True)
    line = {
        "metric": "headline queries, sum of median warm seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "first_run": first,
        "skew": {
            "uniform": round(uniform, 3),
            "one_feed_nine_tenths": round(hot, 3),
            "factor": round(hot / uniform, 2),
        },
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
        "spark": __version__,
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
