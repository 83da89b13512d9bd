"""Feed dates and durations as column expressions that never raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapfold.functions.text import js_trim
from snapfold.functions.zones import DAY_MS, at_most_longest

# Shapes of a date, a date-time and a duration.
DATE_SHAPE = r"[0-9]{8}"
DATE_TIME_SHAPE = r"[0-9]{8}T[0-9]{6}Z?"
DURATION_SHAPE = (
    r"([+-])?P(?:([0-9]+)W)?(?:([0-9]+)D)?"
    r"(?:T(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+)S)?)?"
)
# The last millisecond of the year 9999.
LAST_US = 253_402_300_799_999_000
UNIT_MS = {2: 604_800_000, 3: 86_400_000, 4: 3_600_000, 5: 60_000, 6: 1_000}


def rollover_seconds(year: Column, month: Column, day: Column, clock: Column) -> Column:
    """Epoch seconds of date fields that may overflow (30 February is 2 March, month 0 is December).

    ``clock`` is in seconds and may exceed a day. Years 0 to 99 count from 1900.
    """
    full_year = F.when(year < 100, year + 1900).otherwise(year)
    january = F.make_date(full_year.cast("int"), F.lit(1), F.lit(1))
    days = F.unix_date(F.add_months(january, (month - 1).cast("int"))).cast("bigint") + day - 1
    return days * 86_400 + clock


def with_ics_date(df: DataFrame, value: str, params: str, out: str) -> DataFrame:
    """Attach ``out``: STRUCT<naive_s, is_date_only, is_utc, bad> of the date line in two columns.

    ``params`` holds the raw parameter text (``;NAME=value;...``). ``naive_s`` is the reading in epoch
    seconds as if it were UTC; only a date-time without Z still has to be read in a zone. A value of
    another shape, or a date-time declared VALUE=DATE, is ``bad``. Trimmed text and flags are columns of
    their own, so that they are computed once.
    """
    text, declared = f"__{out}_text", f"__{out}_declared"
    staged = df.withColumns(
        {
            text: js_trim(F.col(value)),
            declared: F.coalesce(F.upper(param(F.col(params), "VALUE")) == "DATE", F.lit(False)),
        }
    )
    day, time = f"__{out}_day", f"__{out}_time"
    t = F.col(text)
    staged = staged.withColumns(
        {
            day: F.when(
                t.rlike(f"^(?:{DATE_SHAPE}|{DATE_TIME_SHAPE})\\z"), F.substring(t, 1, 8).try_cast("int")
            ),
            time: F.when(
                t.rlike(f"^{DATE_TIME_SHAPE}\\z"), F.substring(t, 10, 6).try_cast("int")
            ),
        }
    )
    d, c = F.col(day), F.col(time)
    staged = staged.withColumns(
        {
            # The year, month and day of the reading, and the seconds of its clock.
            f"{day}_y": F.floor(d / 10_000),
            f"{day}_m": F.floor(d / 100) % 100,
            f"{day}_s": d % 100,
            time: F.floor(c / 10_000) * 3_600 + (F.floor(c / 100) % 100) * 60 + c % 100,
            f"{out}__bad": d.isNull() | (c.isNotNull() & F.col(declared)),
            f"{out}__only": d.isNotNull() & c.isNull(),
        }
    )
    bad, date_only = F.col(f"{out}__bad"), F.col(f"{out}__only")
    naive = rollover_seconds(
        F.col(f"{day}_y"), F.col(f"{day}_m"), F.col(f"{day}_s"), F.coalesce(F.col(time), F.lit(0))
    )
    read = F.struct(
        F.when(~bad, naive).alias("naive_s"),
        date_only.alias("is_date_only"),
        (date_only | F.endswith(t, F.lit("Z"))).alias("is_utc"),
        bad.alias("bad"),
    )
    spare = (text, declared, day, time, f"{day}_y", f"{day}_m", f"{day}_s", f"{out}__bad", f"{out}__only")
    return staged.withColumn(out, F.when(t.isNotNull(), read)).drop(*spare)


SEGMENT = r'(?:[^";]++|"[^"]*+")*+'


def param(params: Column, name: str) -> Column:
    """Value of a parameter in raw parameter text, empty if there is none; the last duplicate wins.

    Outer quotes are removed. Possessive runs keep the match free of recursion. A start inside a quoted
    value leaves an odd number of quotes and cannot reach the end, so it never matches.
    """
    pattern = rf"(?i);{name}=({SEGMENT})(?:;(?!{name}=){SEGMENT})*+\z"
    found = F.regexp_extract(params, pattern, 1)
    return F.when(params != "", F.regexp_replace(found, r'(?s)^"(.*)"\z', "$1"))


def duration_ms(col: Column) -> Column:
    """Signed milliseconds of a duration, NULL where the text is not one."""
    text = js_trim(col)
    whole = f"^{DURATION_SHAPE}$"
    # Doubles hold all sums below the longest span exactly; what is longer counts as it.
    magnitude = F.lit(0.0)
    for group, unit in UNIT_MS.items():
        # The leading zero gives an absent part a value; a failing cast costs an exception per row.
        part = F.concat(F.lit("0"), F.regexp_extract(text, whole, group)).try_cast("double")
        magnitude = magnitude + F.coalesce(part, F.lit(0.0)) * unit
    magnitude = at_most_longest(magnitude, DAY_MS).cast("bigint")
    sign = F.when(F.startswith(text, F.lit("-")), F.lit(-1)).otherwise(F.lit(1))
    return F.when(text.rlike(whole), sign * magnitude)


def event_end(
    start: Column, is_all_day: Column, dtend: Column, duration: Column, default_minutes: Column
) -> Column:
    """End of an event: given end, else duration, else one day or the default length.

    An end before the start is replaced by that default; an end equal to the start is kept. A length that goes
    beyond the year 9999 ends with it.
    """
    start_us = F.unix_micros(start)
    minutes = at_most_longest(default_minutes.cast("bigint"), 1440)
    filler = F.when(is_all_day, F.lit(86_400_000)).otherwise(minutes * 60_000)

    def after(span: Column) -> Column:
        end = start_us + span * 1000
        return F.when(end > LAST_US, F.greatest(start_us, F.lit(LAST_US))).otherwise(end)

    wanted = F.coalesce(F.unix_micros(dtend), after(duration), after(filler))
    return F.timestamp_micros(F.when(wanted < start_us, after(filler)).otherwise(wanted))
