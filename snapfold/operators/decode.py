"""Feed documents to normalised events.

One document is one row (bounded by the admission ceiling), so splitting it into event blocks is an
explode without a shuffle. The properties of a block are picked with one expression each; every
pattern uses possessive runs, so a hostile line costs time linear in its length and no stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapfold.functions.dates import (
    DATE_SHAPE,
    DATE_TIME_SHAPE,
    DURATION_SHAPE,
    duration_ms,
    event_end,
    param,
    with_ics_date,
)
from snapfold.functions.digest import with_hash
from snapfold.functions.text import LINE_SPACE, js_trim, unescape_text
from snapfold.functions.zones import resolve_zone, wall_to_instant
from snapfold.operators.spread import KEY_ROWS, attach, fits_broadcast

# Fixed value: title of an event that has no SUMMARY line.
UNTITLED = "(untitled)"

_SEGMENT = r'(?:[^";:\n]++|"[^"\n]*+")*+'
_PARAMS = rf"(?:;{_SEGMENT})*+"
_SPACE = f"{LINE_SPACE}*+"
_LINE_END = r"(?=\n|\z)"
# A letter that upper-cases to I is an I in a keyword, hence the dotless one.
_BEGIN = rf"(?imd)^BEG[i\x{{131}}]N{_PARAMS}:{_SPACE}VEVENT{_SPACE}$"
_END = rf"(?imd)^END{_PARAMS}:{_SPACE}VEVENT{_SPACE}$"
_DATE_LINE = rf"\n(?i:DTSTART|DTEND){_PARAMS}:"
_GOOD_DATE_LINE = rf"{_DATE_LINE}{_SPACE}(?:{DATE_TIME_SHAPE}|{DATE_SHAPE}){_SPACE}{_LINE_END}"
_DECLARED_DATE_WITH_TIME = (
    r"\n(?i:DTSTART|DTEND)(?=;)[^\n]*?;(?i:VALUE)=(\"?)(?i:DATE)\1"
    rf"(?:;(?!(?i:VALUE)=){_SEGMENT})*+:{_SPACE}{DATE_TIME_SHAPE}{_SPACE}{_LINE_END}"
)


def document_text(content: Column) -> Column:
    """Decode UTF-8 with U+FFFD for bad bytes and without a leading byte-order mark."""
    text = F.make_valid_utf8(content.cast("string"))
    bom = F.lit(chr(0xFEFF))
    return F.when(F.startswith(text, bom), F.substring(text, F.lit(2), F.length(text))).otherwise(text)


def unfold(text: Column) -> Column:
    """Join continuation lines to the line before and make every line break a line feed."""
    joined = F.regexp_replace(text, r"(?:\r\n|\n|\r)[ \t]", "")
    return F.regexp_replace(joined, r"\r\n?", "\n")


def vevent_blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per BEGIN:VEVENT with its lines up to the first END; ``closed`` tells whether one came."""
    keep = [c for c in docs.columns if c != text]
    blocks = docs.select(*keep, F.posexplode(F.split(F.col(text), _BEGIN)).alias("pos", "__block"))
    return (
        blocks.where("pos > 0")
        .withColumn("__cut", F.split("__block", _END, 2))
        .select(*keep, "pos", F.col("__cut")[0].alias("block"), (F.size("__cut") == 2).alias("closed"))
    )


def is_begin(line: Column) -> Column:
    """Whether an unfolded line opens an event block."""
    return line.rlike(_BEGIN)


def is_end(line: Column) -> Column:
    """Whether an unfolded line closes an event block."""
    return line.rlike(_END)


def pick(block: Column, name: str) -> Column:
    """The last line called ``name`` in a block from its colon on; empty if there is none."""
    return F.regexp_extract(block, rf"(?s)^.*\n(?i:{name}){_PARAMS}(:[^\n]*+)", 1)


def pick_line(block: Column, name: str) -> Column:
    """Parameters, colon and value of the last line called ``name``; empty if there is none."""
    return F.regexp_extract(block, rf"(?s)^.*\n(?i:{name})({_PARAMS}:[^\n]*+)", 1)


def pick_duration(block: Column) -> Column:
    """Text of the last valid DURATION line; empty if there is none."""
    shape = DURATION_SHAPE.replace("([0-9]+)", "[0-9]+").replace("([+-])", "[+-]")
    pattern = rf"(?s)^.*\n(?i:DURATION){_PARAMS}:{_SPACE}({shape}){_SPACE}{_LINE_END}"
    return F.regexp_extract(block, pattern, 1)


def has_bad_date(block: Column) -> Column:
    """Whether any DTSTART or DTEND line of a block is malformed, not only the one that counts."""
    return (F.regexp_count(block, F.lit(_DATE_LINE)) != F.regexp_count(block, F.lit(_GOOD_DATE_LINE))) | (
        block.rlike(_DECLARED_DATE_WITH_TIME)
    )


TEXTS = ("uid", "summary", "description", "url")


def properties(blocks: DataFrame) -> DataFrame:
    """Replace ``block`` by its properties as text columns.

    The stages are separate projections on purpose: each refers to the result of the one before several
    times, and a pattern must run once per block.
    """
    block = F.col("block")
    rest = [c for c in blocks.columns if c != "block"]
    found = blocks.select(
        *rest,
        has_bad_date(block).alias("bad"),
        *[pick(block, name.upper()).alias(name) for name in TEXTS],
        pick_line(block, "DTSTART").alias("start_line"),
        pick_line(block, "DTEND").alias("end_line"),
        pick_duration(block).alias("duration"),
    )
    present = found.withColumns(
        {
            **{n: F.substr(F.nullif(F.col(n), F.lit("")), F.lit(2)) for n in TEXTS},
            **{n: F.nullif(F.col(n), F.lit("")) for n in ("start_line", "end_line", "duration")},
        }
    )
    return present.withColumns({n: unescape_text(F.col(n)) for n in TEXTS}).withColumns(
        {n: js_trim(F.col(n)) for n in TEXTS}
    )


def _settings(feeds: DataFrame, zone_dim: DataFrame) -> DataFrame:
    """Default length and fallback zone per feed."""
    return resolve_zone(
        feeds.select("feed_id", "default_duration_minutes", "display_tz"),
        zone_dim,
        "display_tz",
        "fallback_zone",
        F.lit("UTC"),
    ).drop("display_tz")


def _settings_columns() -> list[Column]:
    return [
        F.coalesce("default_duration_minutes", F.lit(30)).alias("default_minutes"),
        F.coalesce("fallback_zone", F.lit("UTC")).alias("fallback_zone"),
    ]


def decode(docs: DataFrame, feeds: DataFrame, zone_dim: DataFrame) -> DataFrame:
    """One row per event block of the documents, with ``bad`` and ``kept`` flags, before dedupe.

    ``bad`` rows spoil their whole snapshot (see the gate); ``kept`` rows are closed and have an
    identity. ``feeds`` gives the default length and the fallback zone.
    """
    spread = ("snapshot_seq", "part")
    small = fits_broadcast(feeds, KEY_ROWS)
    settings = _settings(feeds, zone_dim)
    with_settings = attach(docs, settings, how="left", spread_by=spread, small=small)
    texts = with_settings.select(
        "feed_id",
        "snapshot_seq",
        "part",
        *_settings_columns(),
        unfold(document_text(F.col("content"))).alias("text"),
    )
    return _events(vevent_blocks(texts), zone_dim)


def decode_blocks(blocks: DataFrame, feeds: DataFrame, zone_dim: DataFrame) -> DataFrame:
    """As ``decode``, of blocks (feed_id, snapshot_seq, part, pos, block, closed) that were cut out before."""
    settings = _settings(feeds, zone_dim)
    spread = ("snapshot_seq", "part", "pos")
    rows = attach(blocks, settings, how="left", spread_by=spread, small=fits_broadcast(feeds))
    names = ("feed_id", "snapshot_seq", "part", "pos", "block", "closed")
    return _events(rows.select(*names, *_settings_columns()), zone_dim)


def _events(blocks: DataFrame, zone_dim: DataFrame) -> DataFrame:
    dated = properties(blocks).withColumn(
        "feed_ord", F.shiftleft(F.col("part").cast("bigint"), 32) + F.col("pos")
    )
    for side in ("start", "end"):
        line, value = F.col(f"{side}_line"), F.col(f"{side}_value")
        params = f"{side}_params"
        dated = dated.withColumn(f"{side}_value", F.substring_index(line, ":", -1)).withColumn(
            params, F.substring(line, F.lit(1), F.length(line) - F.length(value) - 1)
        )
        dated = with_ics_date(dated, f"{side}_value", params, f"{side}_date").withColumn(
            f"{side}_tzid", param(F.col(params), "TZID")
        )
        dated = resolve_zone(dated, zone_dim, f"{side}_tzid", f"{side}_zone", F.col("fallback_zone"))

    def instant(side: str) -> Column:
        read = F.col(f"{side}_date")
        wall = wall_to_instant(read.naive_s, F.col(f"{side}_zone"))
        return F.when(read.is_utc, F.timestamp_seconds(read.naive_s)).otherwise(wall)

    events = (
        dated.withColumn("start", instant("start"))
        .withColumn("dtend", instant("end"))
        .withColumn("is_all_day", F.col("start_date.is_date_only"))
    )
    return events.select(
        "feed_id",
        "snapshot_seq",
        "uid",
        "feed_ord",
        F.coalesce("summary", F.lit(UNTITLED)).alias("summary"),
        F.nullif(F.col("description"), F.lit("")).alias("description"),
        F.nullif(F.col("url"), F.lit("")).alias("url"),
        "start",
        event_end(
            F.col("start"),
            F.col("is_all_day"),
            F.col("dtend"),
            duration_ms(F.col("duration")),
            F.col("default_minutes"),
        ).alias("end"),
        "is_all_day",
        "bad",
        (F.col("closed") & has_identity()).alias("kept"),
    )


def has_identity() -> Column:
    """An event needs a uid and a start to be reconciled."""
    return (F.coalesce(F.col("uid"), F.lit("")) != "") & F.col("start").isNotNull()


def last_wins(events: DataFrame, keys: tuple[str, ...] = ("feed_id", "snapshot_seq", "uid")) -> DataFrame:
    """One row per key: the values of the last event, the position of the first.

    An aggregate with a map-side step, so a key that fills a third of the input is reduced before the
    shuffle.
    """
    values = [c for c in events.columns if c not in keys and c != "feed_ord"]
    return (
        events.groupBy(*keys)
        .agg(
            F.max_by(F.struct(*values), F.col("feed_ord")).alias("__last"),
            F.min("feed_ord").alias("feed_ord"),
        )
        .select(*keys, "feed_ord", "__last.*")
    )


def normalised(
    decoded: DataFrame, keys: tuple[str, ...] = ("feed_id", "snapshot_seq", "uid")
) -> DataFrame:
    """Events of decoded documents: identified, one per key, with digest."""
    kept = decoded.where("kept").drop("kept", "bad")
    return with_hash(last_wins(kept, keys))


_LINE = rf"(?s)^([^:;\"]++)({_PARAMS}):(.*)$"


def content_lines(blocks: DataFrame, block: str = "block") -> DataFrame:
    """One row per content line of a block: line_no, name (upper case), params (raw text), value.

    Lines without an unquoted colon or without a name are skipped; read a parameter with ``dates.param``.
    """
    rest = [c for c in blocks.columns if c != block]
    lines = blocks.select(*rest, F.posexplode(F.split(F.col(block), "\n")).alias("line_no", "__line"))
    return lines.where(F.col("__line").rlike(_LINE)).select(
        *rest,
        "line_no",
        F.upper(F.regexp_extract("__line", _LINE, 1)).alias("name"),
        F.regexp_extract("__line", _LINE, 2).alias("params"),
        F.regexp_extract("__line", _LINE, 3).alias("value"),
    )
