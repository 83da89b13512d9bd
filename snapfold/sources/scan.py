"""Landed documents of any size: files are split, and folding and event blocks are carried across the splits.

Lines are numbered within their split and by the counts of the splits before it, so no document is one value, one row
or one task. What comes out is what ``operators.decode.vevent_blocks`` cuts out of whole documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from snapfold.operators.decode import document_text, is_begin, is_end
from snapfold.sources.snapshots import part_number

DOCUMENT = ["feed_id", "snapshot_seq", "part"]
#: Lines that are counted in one task.
CHUNK = 65_536


def _numbered(df: DataFrame, chunk: str, order: list[str], counts: Column, out: str) -> DataFrame:
    """Running number of the rows that count, in the order of chunk and ``order`` within a document.

    Rows are summed up inside (document, chunk); of a document only the chunks' sums are windowed.
    """
    inside = W.partitionBy(*DOCUMENT, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    placed = df.withColumn("__n", F.when(counts, F.lit(1)).otherwise(F.lit(0)))
    before = W.partitionBy(*DOCUMENT).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    bases = (
        placed.groupBy(*DOCUMENT, chunk)
        .agg(F.sum("__n").alias("__sum"))
        .withColumn("__base", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
        .drop("__sum")
    )
    return (
        placed.withColumn("__local", F.sum("__n").over(inside))
        .join(bases, [*DOCUMENT, chunk])
        .withColumn(out, F.col("__base") + F.col("__local"))
        .drop("__n", "__base", "__local")
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(document, line_no, line) of the landed files below a folder, unfolded; as many tasks as there are splits.

    A line that begins with a blank or tab goes on with the one before, wherever that is; only a document's first
    line cannot. A line has to fit one value.
    """
    files = (
        spark.read.schema("value string, feed_id string, snapshot_seq bigint")
        .option("pathGlobFilter", "*.ics")
        .text(path)
        .select(
            "feed_id",
            "snapshot_seq",
            part_number(F.col("_metadata.file_path")).alias("part"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("at"),
            document_text(F.col("value").cast("binary")).alias("text"),
            F.make_valid_utf8("value").alias("line"),
        )
        .where(F.col("part").isNotNull())
    )
    first = F.row_number().over(W.partitionBy(*DOCUMENT, "split").orderBy("at")) == 1
    whole = files.withColumn("first", first & (F.col("split") == 0))
    # a byte-order mark is dropped in front of a document only
    folded = ~F.col("first") & F.col("line").rlike("^[ \\t]")
    pieces = whole.select(
        *DOCUMENT,
        "split",
        "at",
        folded.alias("folded"),
        F.when(F.col("first"), F.col("text")).when(folded, F.substr("line", F.lit(2))).otherwise(F.col("line")).alias("piece"),
    )
    numbered = _numbered(pieces, "split", ["at"], ~F.col("folded"), "line_no")
    inside = F.transform(F.array_sort(F.collect_list(F.struct("split", "at", "piece"))), lambda p: p["piece"])
    return numbered.groupBy(*DOCUMENT, "line_no").agg(F.array_join(inside, "").alias("line"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(document, pos, block, closed) of the event blocks below a landing folder, for ``decode.decode_blocks``.

    ``pos`` counts the blocks of a document from 1. Lines behind a block's end are dropped before its lines are put
    together, so what lies between blocks may be of any size; a block has to fit one value.
    """
    lines = read_lines(spark, path).withColumn("chunk", F.floor(F.col("line_no") / CHUNK))
    lines = lines.withColumn("begins", is_begin(F.col("line")))
    numbered = _numbered(lines, "chunk", ["line_no"], F.col("begins"), "pos").where("pos > 0")
    block = [*DOCUMENT, "pos"]
    ended = F.min(F.when(~F.col("begins") & is_end(F.col("line")), F.col("line_no"))).over(W.partitionBy(*block))
    held = numbered.withColumn("end", ended).where("end IS NULL OR line_no < end")
    body = F.transform(F.array_sort(F.collect_list(F.when(~F.col("begins"), F.struct("line_no", "line")))), lambda x: x["line"])
    return held.groupBy(*block).agg(
        F.concat(F.lit("\n"), F.array_join(body, "\n"), F.lit("\n")).alias("block"), F.max("end").isNotNull().alias("closed")
    )
