"""Content digest of an event."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from snapfold.functions.zones import iso_ms

# Fixed value: separator of the digest material. A field that contains it can make two different
# events look equal; that is part of the format.
SEPARATOR = "|"


def event_hash(
    summary: Column, description: Column, url: Column, start: Column, end: Column, is_all_day: Column
) -> Column:
    """SHA-256 over the fields whose change needs a rewrite. The uid is not among them."""
    empty = F.lit("")
    return F.sha2(
        F.concat_ws(
            SEPARATOR,
            F.coalesce(summary, empty),
            F.coalesce(description, empty),
            F.coalesce(url, empty),
            iso_ms(start),
            iso_ms(end),
            is_all_day.cast("string"),
        ),
        256,
    )


def with_hash(df):
    """Attach ``hash`` to a frame that has the event columns."""
    names = ("summary", "description", "url", "start", "end", "is_all_day")
    return df.withColumn("hash", event_hash(*(F.col(n) for n in names)))
