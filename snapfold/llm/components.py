"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapfold.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node but the roots; root is the smallest node of its component.

    ``edges`` has columns a and b; direction, repeats and loops don't matter, rows with a null are no edges.
    Each round links all neighbours of a node to the smallest of them, first the larger ones, then the smaller
    ones, until nothing changes; the number of rounds grows with the logarithm of the longest path. A node with
    very many neighbours is only ever a side of an equality join with one row for that node, which Spark's
    skewed-join handling splits.
    """
    spark = edges.sparkSession
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct())
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            break
        before = state
        both = now.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(
            now.select(F.col("m").alias("u"), F.col("v").alias("w"))
        )
        least = both.groupBy("u").agg(F.min("w").alias("s")).select("u", F.least("s", "u").alias("s"))
        large = both.join(least, "u").where("w > u").select(F.col("w").alias("v"), F.col("s").alias("m")).distinct()
        low = large.groupBy("v").agg(F.min("m").alias("s"))
        joined = large.join(low, "v")
        now = cut(
            joined.where("m <> s").select(F.col("m").alias("v"), F.col("s").alias("m")).unionByName(
                low.select("v", F.col("s").alias("m"))
            ).distinct()
        )
    return spark.createDataFrame([], "node bigint, root bigint") if not state["n"] else now.select(
        F.col("v").alias("node"), F.col("m").alias("root")
    )
