"""What a stream has seen: the parts of snapshots that are not complete yet, and when each feed last landed something.

A batch's ledger is made from the one before and from what the batch names, and written before the batch's run. So a
batch costs what it adds and what is still open, not what has landed ever. A batch that is repeated reads the same ledger
before it and writes the same again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapfold.sources.folders import exists, remove

OPEN = "feed_id string, snapshot_seq bigint, part bigint, parts bigint"
HEADS = "feed_id string, newest_seq bigint, newest_ts timestamp"


class Ledger:
    """The ledger of one stream below a folder, one pair of tables per batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _at(self, batch_id: int, name: str) -> str:
        return f"{self.folder}/{batch_id}/{name}"

    def _read(self, batch_id: int, name: str, schema: str) -> DataFrame:
        if batch_id < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._at(batch_id, name))

    def begin(self, batch_id: int, landed: Callable[[], DataFrame]) -> None:
        """Where the batch before left no ledger, as an older version ran it, make one from all that has landed."""
        if batch_id > 0 and not exists(self.spark, self._at(batch_id - 1, "open/_SUCCESS")):
            self.add(batch_id - 1, landed(), first=True)

    def add(self, batch_id: int, documents: DataFrame, first: bool = False) -> tuple[DataFrame, DataFrame]:
        """Take in a batch's documents; returns (snapshots that it completes, those of them begun by earlier batches).

        A part that lands again counts once. Parts of snapshots that are older than the feed's newest complete one
        wait for nothing and are forgotten, so what is open does not pile up.
        """
        before = -1 if first else batch_id - 1
        named = documents.select("feed_id", "snapshot_seq", "part", "parts", "snapshot_ts")
        key = ["feed_id", "snapshot_seq"]
        held = self._read(before, "open", OPEN)
        parts = held.withColumn("new", F.lit(False)).unionByName(
            named.drop("snapshot_ts").withColumn("new", F.lit(True))
        )
        counted = parts.groupBy(*key).agg(
            (F.countDistinct("part") >= F.max("parts")).alias("whole"),
            F.bool_or("new").alias("touched"),
            F.bool_and("new").alias("all_new"),
        )
        done = counted.where("whole AND touched")
        newest = done.groupBy("feed_id").agg(F.max("snapshot_seq").alias("newest"))
        landed = named.groupBy("feed_id").agg(F.max("snapshot_ts").alias("newest_ts")).join(newest, "feed_id", "left")
        heads = (
            self._read(before, "heads", HEADS)
            .unionByName(landed.withColumnRenamed("newest", "newest_seq"))
            .groupBy("feed_id")
            .agg(F.max("newest_seq").alias("newest_seq"), F.max("newest_ts").alias("newest_ts"))
        )
        heads.write.mode("overwrite").parquet(self._at(batch_id, "heads"))
        heads = self._read(batch_id, "heads", HEADS)
        waiting = parts.select(*key, "part", "parts").distinct().join(counted.where("NOT whole"), key, "left_semi")
        late = waiting.join(heads.where(F.col("newest_seq").isNotNull()), "feed_id", "left")
        still = late.where("newest_seq IS NULL OR snapshot_seq > newest_seq").select(*key, "part", "parts")
        still.write.mode("overwrite").parquet(self._at(batch_id, "open"))
        for old in (batch_id - 2, batch_id - 3):
            if old >= 0:
                remove(self.spark, f"{self.folder}/{old}")
        return done.select(*key), done.where("NOT all_new").select(*key)

    def silent(self, batch_id: int, feeds: DataFrame, now: dt.datetime, max_age: dt.timedelta) -> DataFrame:
        """(feed_id) of the registered feeds that landed nothing since ``now - max_age``, or nothing ever."""
        oldest = F.lit(now - max_age).cast("timestamp")
        landed = feeds.select("feed_id").join(self._read(batch_id, "heads", HEADS), "feed_id", "left")
        return landed.where(F.col("newest_ts").isNull() | (F.col("newest_ts") < oldest)).select("feed_id")
