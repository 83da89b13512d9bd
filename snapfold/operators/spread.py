"""Joins and numbering that stay spread out when one feed holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A per-feed table of up to this many narrow rows (tens of MB) is sent to every executor.
BROADCAST_ROWS = 200_000
# Where the large side carries whole documents, a key table of this many rows (a few hundred MB) is still
# cheaper to send than the documents are to shuffle.
KEY_ROWS = 2_000_000
# A key with more rows than this is spread over SALTS tasks; there are at most rows / HOT_ROWS such keys.
HOT_ROWS = 1_000_000
SALTS = 32


def fits_broadcast(dim: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a per-feed table is small enough to broadcast; reads at most ``max_rows + 1`` rows."""
    return dim.limit(max_rows + 1).count() <= max_rows


def attach(
    df: DataFrame,
    dim: DataFrame,
    keys: tuple[str, ...] = ("feed_id",),
    how: str = "inner",
    spread_by: tuple[str, ...] = ("uid",),
    small: bool | None = None,
    count_hot: bool = True,
) -> DataFrame:
    """Join a table of one row per key (a feed, or a feed's snapshot) onto a large table.

    A small one is broadcast; ``small`` passes the outcome of a size check already made. A larger one is
    joined on the key, with the hot keys spread: their rows get a salt taken from ``spread_by`` and the
    rows they meet are repeated once per salt. The hot keys are found by a count with a map-side step.
    Where the large side is too costly to compute twice, ``count_hot=False`` leaves hot keys to the
    splitting of skewed partitions at run time.
    """
    if small is None:
        small = fits_broadcast(dim)
    if small:
        return df.join(F.broadcast(dim), list(keys), how)
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int")
    # Rows without a key match nothing, so they can be spread freely.
    keyless = F.coalesce(*[F.when(F.col(k).isNull(), True) for k in keys], F.lit(False))
    if not count_hot:
        return (
            df.withColumn("__salt", F.when(keyless, salt).otherwise(F.lit(0)))
            .join(dim.withColumn("__salt", F.lit(0)), [*keys, "__salt"], how)
            .drop("__salt")
        )
    counts = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    hot = F.broadcast(counts.where(F.col("__n") > HOT_ROWS).select(*keys, F.lit(True).alias("__hot")))
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    salted = (
        df.join(hot, list(keys), "left")
        .withColumn("__salt", F.when(F.col("__hot") | keyless, salt).otherwise(F.lit(0)))
        .drop("__hot")
    )
    repeated = (
        dim.join(hot, list(keys), "left")
        .withColumn("__salt", F.explode(F.when(F.col("__hot"), every).otherwise(F.array(F.lit(0)))))
        .drop("__hot")
    )
    return salted.join(repeated, [*keys, "__salt"], how).drop("__salt")


def position_within(
    df: DataFrame, group: list[str], chunk: str, order: list[Column | str], out: str
) -> DataFrame:
    """0-based position of each row in its group, without putting a group into one task.

    ``chunk`` must not decrease along ``order``. Rows are numbered inside (group, chunk); the counts of
    the earlier chunks are added. Only the counts, a few rows per group, are windowed by group.
    """
    keys = [*group, chunk]
    before = W.partitionBy(*group).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    bases = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    inside = W.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("__at", F.row_number().over(inside))
        .join(bases, keys)
        .withColumn(out, F.col("__base") + F.col("__at") - 1)
        .drop("__base", "__at")
    )


def digest_bucket(col: Column) -> Column:
    """One of 4096 evenly filled buckets of a key, the same in every engine that has SHA-256."""
    return F.conv(F.substring(F.sha2(col, 256), 1, 3), 16, 10).cast("bigint")
