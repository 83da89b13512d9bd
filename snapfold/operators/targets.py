"""Which calendar each feed writes to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapfold.operators.spread import attach


def resolve_targets(feeds: DataFrame, feed_state: DataFrame, targets: DataFrame) -> DataFrame:
    """Calendar per feed: feed_id, calendar_id, resolution.

    The id stored for the feed if its owner still has it (``known``), else the owner's first calendar of
    the wanted name in list order (``matched``), else none (``missing``, to be created outside).
    ``targets`` is the catalogue: target_upn, calendar_id, name, list_ord.
    """
    wanted = feeds.select("feed_id", "target_upn", "calendar_name").join(
        feed_state.select("feed_id", F.col("calendar_id").alias("stored_id")), "feed_id", "left"
    )
    alive = targets.select("target_upn", F.col("calendar_id").alias("stored_id")).distinct()
    by_name = targets.groupBy("target_upn", F.col("name").alias("calendar_name")).agg(
        F.min_by("calendar_id", "list_ord").alias("named_id")
    )
    alive = alive.withColumn("alive", F.lit(True))
    known = F.coalesce(F.col("alive"), F.lit(False))
    owned = attach(wanted, alive, ("target_upn", "stored_id"), "left", spread_by=("feed_id",))
    return (
        attach(owned, by_name, ("target_upn", "calendar_name"), "left", spread_by=("feed_id",))
        .select(
            "feed_id",
            F.when(known, F.col("stored_id")).otherwise(F.col("named_id")).alias("calendar_id"),
            F.when(known, "known")
            .when(F.col("named_id").isNotNull(), "matched")
            .otherwise("missing")
            .alias("resolution"),
        )
    )
