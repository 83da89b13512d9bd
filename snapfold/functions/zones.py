"""Conversions between instants and wall clocks. Sessions run in UTC."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MICROS = 1_000_000
DAY_MS = 86_400_000
# More days than any two timestamps are apart; a span is never longer, so that sums of micros fit 64 bits.
LONGEST_DAYS = 50_000_000

_zone_lists: dict[str, list[tuple[str, str]]] = {}



def at_most_longest(span: Column, per_day: int) -> Column:
    """A span, of so many units a day, that is cut at the longest one; NULL stays NULL."""
    longest = LONGEST_DAYS * per_day
    return F.when(span > longest, F.lit(longest)).otherwise(span)


def zones(spark: SparkSession) -> DataFrame:
    """Dimension lower-cased id -> id, of every zone this runtime converts with (about 600 rows).

    The list is bounded by the zone database, so joining it as a broadcast is safe at any scale.
    """
    app = spark.sparkContext.applicationId
    if app not in _zone_lists:
        named = [(name,) for name in sorted(zoneinfo.available_timezones())]
        known = (
            spark.createDataFrame(named, "zone string")
            .where(F.expr("try_make_timestamp_ltz(2000, 1, 1, 0, 0, 0, zone)").isNotNull())
            .collect()
        )
        if not known:
            raise RuntimeError("this Python has no time zone database, so every zone would be unknown")
        _zone_lists[app] = [(r.zone.lower(), r.zone) for r in known]
    return spark.createDataFrame(_zone_lists[app], "zone_key string, zone string")


def resolve_zone(df: DataFrame, zone_dim: DataFrame, col: str, out: str, fallback: Column) -> DataFrame:
    """Attach ``out``: the recognised zone named by ``col`` in any letter case, else ``fallback``."""
    key, hit = f"__{out}_key", f"__{out}_hit"
    dim = F.broadcast(zone_dim.select(F.col("zone_key").alias(key), F.col("zone").alias(hit)))
    return (
        df.join(dim, F.lower(F.col(col)) == F.col(key), "left")
        .withColumn(out, F.coalesce(F.col(hit), fallback))
        .drop(key, hit)
    )


def zone_offset_ms(instant: Column, zone: Column) -> Column:
    """Milliseconds the zone is ahead of UTC at an instant, second-aligned."""
    shifted = F.unix_seconds(F.from_utc_timestamp(instant, zone))
    return (shifted - F.unix_seconds(instant)) * 1000


def wall_to_instant(naive_s: Column, zone: Column, mode: str = "two_pass") -> Column:
    """Instant of a wall-clock reading given as naive epoch seconds.

    ``two_pass`` takes the offset at the naive reading, then the offset at the instant that gives;
    this is the default and decides the readings in a gap or an overlap. ``java`` follows the rule of
    the JVM instead: the earlier offset in an overlap, shifted forward in a gap.
    """
    if mode == "java":
        return F.to_utc_timestamp(F.timestamp_seconds(naive_s), zone)
    if mode != "two_pass":
        raise ValueError(f"unknown mode {mode}")

    def offset(seconds: Column) -> Column:
        instant = F.timestamp_seconds(seconds)
        return F.unix_seconds(F.from_utc_timestamp(instant, zone)) - seconds

    first = naive_s - offset(naive_s)
    return F.timestamp_seconds(naive_s - offset(first))


def format_wall(instant: Column, zone: Column) -> Column:
    """Wall clock a zone shows at an instant, without offset."""
    return F.date_format(F.from_utc_timestamp(instant, zone), "yyyy-MM-dd'T'HH:mm:ss")


def format_day(instant: Column) -> Column:
    """All-day boundary: the UTC day, because an all-day date has no zone to be read in."""
    return F.date_format(instant, "yyyy-MM-dd'T00:00:00'")


def iso_ms(instant: Column) -> Column:
    """ISO-8601 in UTC with milliseconds."""
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_iso(col: Column) -> Column:
    """Instant of an ISO-8601 text, NULL if it is not one. A date alone is midnight UTC."""
    text = F.trim(col)
    shape = r"^\d{4}-\d{2}(?:-\d{2}(?:T\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?:Z|[+-]\d{2}:\d{2})?)?)?$"
    return F.when(text.rlike(shape), F.try_to_timestamp(text))
