"""The commit log: a record per run, folded into a snapshot of all earlier ones from time to time.

A reader takes the snapshots and the records that are there and keeps one record per run, so it sees the same log
whether a fold stopped before, between or after its steps. The snapshot is one file, which appears as a whole.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from snapfold.sources.folders import remove, runs_below

# ``base_run_seq`` and ``log`` name the state's base and the runs whose changes follow it.
COMMIT = (
    "run_seq bigint, base_run_seq bigint, log array<bigint>, feed_state_run_seq bigint, buckets int, "
    "feed_buckets int"
)

COLUMNS = [x.split()[0] for x in COMMIT.split(", ")]


def _found(spark: SparkSession, kind: str, folder: str) -> DataFrame | None:
    try:
        return getattr(spark.read.schema(COMMIT), kind)(folder).select(*COLUMNS)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_commits(spark: SparkSession, root: str) -> DataFrame | None:
    """All commit records, one per run, or None before the first."""
    records, folded = _found(spark, "json", f"{root}/commits"), _found(spark, "parquet", f"{root}/commit_log")
    both = [x for x in (records, folded) if x is not None]
    if not both:
        return None
    return both[0] if len(both) == 1 else both[0].unionByName(both[1]).dropDuplicates(["run_seq"])


def write_commit(spark: SparkSession, root: str, row: tuple, fold_every: int) -> None:
    """Write a run's record; when ``fold_every`` of them are in no snapshot, fold the log.

    However many runs there have been, there are at most twice as many records and two snapshots.
    """
    record = spark.createDataFrame([row], COMMIT)
    record.coalesce(1).write.mode("overwrite").json(f"{root}/commits/run_seq={row[0]}")
    last = runs_below(spark, f"{root}/commit_log", "upto")[-1:]
    if sum(r > (last[0] if last else -1) for r in runs_below(spark, f"{root}/commits")) >= fold_every:
        fold_commits(spark, root)


def fold_commits(spark: SparkSession, root: str) -> None:
    """Write a snapshot of the whole log; remove the records that the one before it holds already.

    So a reader that has listed the folders finds their files until the next fold.
    """
    records = runs_below(spark, f"{root}/commits")
    if not records:
        return
    folded = runs_below(spark, f"{root}/commit_log", "upto")
    read_commits(spark, root).coalesce(1).write.mode("overwrite").parquet(f"{root}/commit_log/upto={max(records[-1], *folded, -1)}")
    for upto in folded[:-1]:
        remove(spark, f"{root}/commit_log/upto={upto}")
    for run_seq in records:
        if folded and run_seq <= folded[-1]:
            remove(spark, f"{root}/commits/run_seq={run_seq}")
