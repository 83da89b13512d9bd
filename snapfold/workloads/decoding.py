"""Queries over documents, dates, zones and durations."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapfold.functions.dates import duration_ms, event_end, with_ics_date
from snapfold.functions.zones import format_wall, iso_ms, wall_to_instant, zone_offset_ms, zones
from snapfold.operators.decode import (
    content_lines,
    decode,
    document_text,
    normalised,
    unfold,
    vevent_blocks,
)
from snapfold.operators.reconcile import gate
from snapfold.sources.snapshots import MAX_DOCUMENT_BYTES, admit, ics_parts, warn_content_type
from snapfold.workloads.catalog import (
    feed_events,
    hash_sql,
    iso_sql,
    query,
    table,
)

# Zones by return flag and line status; all change their offset, one of them by half an hour.
ZONE_OF = {
    "AF": "America/New_York",
    "AO": "Europe/Oslo",
    "NF": "Australia/Lord_Howe",
    "NO": "Asia/Kolkata",
    "RF": "America/St_Johns",
    "RO": "Pacific/Auckland",
}
_ZONE_SQL = (
    "CASE l_returnflag || l_linestatus "
    + " ".join(f"WHEN '{k}' THEN '{z}'" for k, z in ZONE_OF.items())
    + " END"
)


def _zone():
    flags = F.concat("l_returnflag", "l_linestatus")
    zone = F.lit(None).cast("string")
    for key, name in ZONE_OF.items():
        zone = F.when(flags == key, name).otherwise(zone)
    return zone


def _offset_sql(seconds: str) -> str:
    return f"(CAST(epoch(timezone(zone, to_timestamp({seconds}))) AS BIGINT) - {seconds})"


_NAIVE = f"""
l AS (
  SELECT l_orderkey, l_partkey, l_linenumber, {_ZONE_SQL} AS zone,
         CAST(epoch(l_shipdate) AS BIGINT) + l_linenumber * 1800 AS naive_s
  FROM lineitem)
"""


def _naive(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        _zone().alias("zone"),
        (F.unix_seconds(F.col("l_shipdate").cast("timestamp")) + F.col("l_linenumber") * 1800).alias(
            "naive_s"
        ),
    )


@query(
    "wall_to_instant",
    f"""
    WITH {_NAIVE}, p AS (SELECT *, naive_s - {_offset_sql('naive_s')} AS first_s FROM l)
    SELECT l_orderkey, l_partkey, l_linenumber, naive_s - {_offset_sql('first_s')} AS instant_s FROM p
    """,
)
def walls_to_instants(spark, sf_dir):
    instant = wall_to_instant(F.col("naive_s"), F.col("zone"))
    return _naive(spark, sf_dir).select(
        "l_orderkey", "l_partkey", "l_linenumber", F.unix_seconds(instant).alias("instant_s")
    )


@query(
    "instant_to_wall",
    f"""
    WITH {_NAIVE}
    SELECT l_orderkey, l_partkey, l_linenumber,
           strftime(timezone(zone, to_timestamp(naive_s)), '%Y-%m-%dT%H:%M:%S') AS wall,
           {_offset_sql('naive_s')} * 1000 AS offset_ms
    FROM l
    """,
)
def instants_to_walls(spark, sf_dir):
    instant = F.timestamp_seconds("naive_s")
    return _naive(spark, sf_dir).select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        format_wall(instant, F.col("zone")).alias("wall"),
        zone_offset_ms(instant, F.col("zone")).alias("offset_ms"),
    )


# Date lines whose fields overflow: months up to 21, days up to 50, hours up to 35; every third shape.
_FIELDS = """
f AS (
  SELECT l_orderkey, l_partkey, l_linenumber, year(l_shipdate) AS y, l_linenumber * 3 AS mo,
         CAST(l_quantity AS BIGINT) AS d, l_linenumber * 5 AS h, CAST(l_discount * 900 AS BIGINT) AS mi,
         CAST(round(l_tax * 100) AS BIGINT) + 55 AS s, l_returnflag AS shape, l_linestatus AS declared
  FROM lineitem)
"""


@query(
    "ics_dates",
    f"""
    WITH {_FIELDS}, t AS (
      SELECT *, CAST(epoch(make_date(y, 1, 1) + to_months(CAST(mo - 1 AS INT))) AS BIGINT) + (d - 1) * 86400
             AS midnight
      FROM f)
    SELECT l_orderkey, l_partkey, l_linenumber,
           CASE WHEN shape = 'A' THEN midnight WHEN shape = 'N' AND declared = 'F' THEN NULL
                ELSE midnight + h * 3600 + mi * 60 + s END AS naive_s,
           shape = 'A' AS is_date_only, shape <> 'R' AS is_utc, shape = 'N' AND declared = 'F' AS bad
    FROM t
    """,
)
def ics_dates(spark, sf_dir):
    def digits(col, width=2):
        return F.lpad(col.cast("bigint").cast("string"), width, "0")

    day = F.concat(
        digits(F.year("l_shipdate"), 4), digits(F.col("l_linenumber") * 3), digits(F.col("l_quantity"))
    )
    time = F.concat(
        F.lit("T"),
        digits(F.col("l_linenumber") * 5),
        digits(F.round(F.col("l_discount") * 900)),
        digits(F.round(F.col("l_tax") * 100) + 55),
    )
    shape = F.col("l_returnflag")
    value = (
        F.when(shape == "A", day)
        .when(shape == "N", F.concat(F.lit(" "), day, time, F.lit("Z")))
        .otherwise(F.concat(day, time, F.lit("\t")))
    )
    declared = F.when((shape == "N") & (F.col("l_linestatus") == "F"), ';VALUE="date"').otherwise(
        ";TZID=Europe/Oslo"
    )
    key = ["l_orderkey", "l_partkey", "l_linenumber"]
    lines = table(spark, sf_dir, "lineitem").select(
        *key, value.alias("value"), declared.alias("params")
    )
    return with_ics_date(lines, "value", "params", "read").select(*key, "read.*")


@query(
    "duration_ms",
    """
    SELECT l_orderkey, l_partkey, l_linenumber,
           CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN NULL
                ELSE (CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END)
                     * (CAST(l_quantity AS BIGINT) * 86400000 + l_linenumber * 3600000
                        + CAST(round(l_tax * 100) AS BIGINT) * 60000) END AS ms
    FROM lineitem
    """,
)
def durations(spark, sf_dir):
    text = F.concat(
        F.when(F.col("l_returnflag") == "R", "-").when(F.col("l_linestatus") == "O", "+").otherwise(""),
        F.lit("P"),
        F.col("l_quantity").cast("bigint").cast("string"),
        F.lit("DT"),
        F.col("l_linenumber").cast("string"),
        F.lit("H"),
        F.round(F.col("l_tax") * 100).cast("bigint").cast("string"),
        F.when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"), "m").otherwise("M"),
    )
    key = ["l_orderkey", "l_partkey", "l_linenumber"]
    texts = table(spark, sf_dir, "lineitem").select(*key, text.alias("text"))
    return texts.select(*key, duration_ms(F.col("text")).alias("ms"))


@query(
    "event_end",
    f"""
    WITH e AS (
      SELECT l_orderkey, l_partkey, l_linenumber, l_shipdate AS st, l_linestatus = 'F' AS is_all_day,
             CASE WHEN l_returnflag = 'A'
                  THEN l_shipdate + to_days(CAST(l_quantity AS INT) - 25) END AS dtend,
             CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) - 10 END AS hours,
             CASE WHEN l_linestatus = 'F' THEN INTERVAL 1 DAY ELSE to_minutes(l_linenumber * 10) END AS filler
      FROM lineitem),
    w AS (SELECT *, coalesce(dtend, st + to_hours(hours), st + filler) AS wanted FROM e)
    SELECT l_orderkey, l_partkey, l_linenumber,
           {iso_sql("CASE WHEN wanted < st THEN st + filler ELSE wanted END")} AS ends FROM w
    """,
)
def event_ends(spark, sf_dir):
    start = F.col("l_shipdate").cast("timestamp")
    days = F.col("l_quantity").cast("bigint") - 25
    dtend = F.timestamp_seconds(F.unix_seconds(start) + days * 86_400)
    hours = F.col("l_quantity").cast("bigint") - 10
    ends = event_end(
        start,
        F.col("l_linestatus") == "F",
        F.when(F.col("l_returnflag") == "A", dtend),
        F.when(F.col("l_returnflag") == "N", hours * 3_600_000),
        F.col("l_linenumber") * 10,
    )
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", iso_ms(ends).alias("ends")
    )


def as_documents(parts):
    """Rendered parts as landed documents."""
    content = F.col("text").cast("binary")
    return parts.select(
        "feed_id",
        "snapshot_seq",
        F.lit("2024-02-01").cast("timestamp").alias("snapshot_ts"),
        F.col("part").cast("bigint").alias("part"),
        "parts",
        F.octet_length(content).cast("bigint").alias("length"),
        content.alias("content"),
    )


def feed_settings(feeds):
    """Settings of each feed; the zone only matters for times that name none."""
    return feeds.select(
        "feed_id",
        F.lit(30).alias("default_duration_minutes"),
        F.when(F.col("feed_id") < "f", "Europe/Oslo").otherwise("utc").alias("display_tz"),
    )


def event_documents(spark, sf_dir):
    """All events, each under a key of its own, rendered as feed documents."""
    ev = feed_events(spark, sf_dir).withColumn("uid", F.col("feed_ord").cast("string"))
    whole_seconds = {
        c: F.timestamp_seconds(F.unix_seconds(c)).alias(c) for c in ("start", "end")
    }
    return as_documents(ics_parts(ev.withColumns(whole_seconds), per_part=500))


_ROUND = """
ev AS (
  SELECT event_type AS feed_id, CAST(event_id AS VARCHAR) AS uid, event_type || ' ' || props AS summary,
         CASE WHEN value >= 50 THEN 'value, ' || props END AS description,
         'https://feeds.example.org/' || event_type || '?u=' || user_id AS url,
         date_trunc('second', ts) AS "start", date_trunc('second', ts) + INTERVAL 30 MINUTE AS "end"
  FROM events)
"""


@query(
    "ics_roundtrip",
    f"""
    WITH {_ROUND}
    SELECT feed_id, uid, summary, description, url, {iso_sql('"start"')} AS "start",
           {iso_sql('"end"')} AS "end", {hash_sql()} AS hash FROM ev
    """,
)
def ics_roundtrip(spark, sf_dir):
    docs = event_documents(spark, sf_dir)
    feeds = table(spark, sf_dir, "events").select(F.col("event_type").alias("feed_id")).distinct()
    settings = feed_settings(feeds)
    events = normalised(decode(docs, settings, zones(spark)))
    return events.select(
        "feed_id",
        "uid",
        "summary",
        "description",
        "url",
        iso_ms(F.col("start")).alias("start"),
        iso_ms(F.col("end")).alias("end"),
        "hash",
    )


# Documents as all-day events: the whole text is the description, the language is the feed.
_DOCS = """
ev AS (
  SELECT lang AS feed_id, CAST(doc_id AS VARCHAR) AS uid, source || '; ' || lang AS summary,
         nullif(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)
                || chr(65279)), '') AS description,
         CAST(NULL AS VARCHAR) AS url,
         TIMESTAMP '2024-01-01' + to_days(CAST(n_chars AS INT)) AS "start",
         TIMESTAMP '2024-01-02' + to_days(CAST(n_chars AS INT)) AS "end"
  FROM documents)
"""


@query(
    "ics_roundtrip_documents",
    f"""
    WITH {_DOCS}
    SELECT feed_id, uid, summary, length(description) AS n, {iso_sql('"start"')} AS "start",
           {hash_sql("'true'")} AS hash FROM ev
    """,
)
def ics_roundtrip_documents(spark, sf_dir):
    start = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("n_chars") * 86_400)
    d = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("feed_id"),
        F.lit(1).cast("bigint").alias("snapshot_seq"),
        F.col("doc_id").cast("string").alias("uid"),
        F.col("doc_id").alias("feed_ord"),
        F.concat_ws("; ", "source", "lang").alias("summary"),
        F.col("text").alias("description"),
        F.lit(None).cast("string").alias("url"),
        start.alias("start"),
        (start + F.expr("INTERVAL 1 DAY")).alias("end"),
        F.lit(True).alias("is_all_day"),
    )
    docs = as_documents(ics_parts(d, per_part=50))
    langs = table(spark, sf_dir, "documents").select(F.col("lang").alias("feed_id")).distinct()
    settings = feed_settings(langs)
    events = normalised(decode(docs, settings, zones(spark)))
    return events.select(
        "feed_id",
        "uid",
        "summary",
        F.char_length("description").cast("bigint").alias("n"),
        iso_ms(F.col("start")).alias("start"),
        "hash",
    )


@query(
    "content_lines",
    f"""
    WITH {_ROUND}, lines AS (
      SELECT feed_id, uid, unnest([
        {{'line_no': 1, 'name': 'UID', 'params': '', 'value': uid}},
        {{'line_no': 2, 'name': 'DTSTART', 'params': '', 'value': strftime("start", '%Y%m%dT%H%M%SZ')}},
        {{'line_no': 3, 'name': 'DTEND', 'params': '', 'value': strftime("end", '%Y%m%dT%H%M%SZ')}},
        {{'line_no': 4, 'name': 'SUMMARY', 'params': '', 'value': summary}},
        {{'line_no': 5, 'name': 'DESCRIPTION', 'params': '', 'value': replace(description, ',', chr(92) || ',')}},
        {{'line_no': CASE WHEN description IS NULL THEN 5 ELSE 6 END, 'name': 'URL', 'params': '', 'value': url}}
      ]) AS l FROM ev)
    SELECT feed_id, l.line_no, l.name, l.params, l.value, count(*) AS n FROM lines
    WHERE l.value IS NOT NULL GROUP BY ALL
    """,
)
def lines_of_blocks(spark, sf_dir):
    docs = event_documents(spark, sf_dir)
    texts = docs.select("feed_id", unfold(document_text(F.col("content"))).alias("text"))
    lines = content_lines(vevent_blocks(texts).drop("pos", "closed"))
    return lines.groupBy("feed_id", "line_no", "name", "params", "value").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "decoded_gate",
    """
    SELECT event_type AS feed_id, CASE WHEN bool_or(value >= 200) THEN 'ics-parse-failed' END AS aborted,
           count(*) FILTER (value < 200) AS events
    FROM events GROUP BY event_type
    """,
)
def decoded_gate(spark, sf_dir):
    """An event of 200 or more gets a malformed start line, which spoils its whole snapshot."""
    e = table(spark, sf_dir, "events")
    start = F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd'T'HHmmss'Z'")
    block = F.concat_ws(
        "\r\n",
        F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:"), F.col("event_id").cast("string")),
        F.concat(F.lit("DTSTART:"), F.when(F.col("value") < 200, start).otherwise("soon")),
        F.lit("END:VEVENT"),
        F.lit(""),
    )
    # One part per event, so that no document grows with its feed.
    parts = e.select(
        F.col("event_type").alias("feed_id"),
        F.lit(1).cast("bigint").alias("snapshot_seq"),
        F.col("event_id").alias("part"),
        F.lit(1).alias("parts"),
        block.alias("text"),
    )
    docs = as_documents(parts)
    feeds = e.select(F.col("event_type").alias("feed_id")).distinct()
    settings = feed_settings(feeds)
    decoded = decode(docs, settings, zones(spark))
    polls = feeds.select("feed_id", F.lit(1).cast("bigint").alias("snapshot_seq"), F.lit(1).alias("parts"))
    return gate(polls, docs, decoded).select("feed_id", "aborted", "events")


@query(
    "admission",
    f"""
    SELECT page_id, strlen(html) AS length, ends_with(url, '.html') AS warn FROM pages
    WHERE strlen(html) * 1000 <= {MAX_DOCUMENT_BYTES}
    """,
)
def admission(spark, sf_dir):
    """Documents of at most a thousandth of the ceiling; web pages are flagged, not rejected."""
    shown_as = F.when(F.endswith("url", F.lit(".html")), "text/html; charset=utf-8").otherwise(
        "Text/Calendar; charset=utf-8"
    )
    pages = table(spark, sf_dir, "pages").select(
        "page_id",
        F.octet_length("html").cast("bigint").alias("length"),
        warn_content_type(shown_as).alias("warn"),
    )
    return admit(pages, MAX_DOCUMENT_BYTES // 1000)


# Events as feeds of other tools write them: folded lines, a zone by name or by a name that none has, a length in
# place of an end, a title given twice, a byte that is no UTF-8, and a blank uid from a value of 100 on.
@query(
    "decoded_oddities",
    f"""
    WITH odd AS (
      SELECT event_type AS feed_id, CAST(event_id AS VARCHAR) AS uid, event_type || ' ' || props AS summary,
             'a' || chr(65533) || 'b ' || props AS description, CAST(NULL AS VARCHAR) AS url,
             timezone('UTC', timezone(CASE user_id % 3 WHEN 0 THEN 'Europe/Oslo' WHEN 1 THEN 'America/New_York'
               ELSE CASE WHEN event_type < 'f' THEN 'Europe/Oslo' ELSE 'UTC' END END, date_trunc('second', ts))) AS "start",
             event_id % 90 AS minutes
      FROM events WHERE value < 100),
    ev AS (SELECT *, "start" + to_minutes(CAST(minutes AS BIGINT)) AS "end" FROM odd)
    SELECT feed_id, uid, summary, description, {iso_sql('"start"')} AS "start", {iso_sql('"end"')} AS "end", {hash_sql()} AS hash FROM ev
    """,
)
def decoded_oddities(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    uid = F.when(F.col("value") < 100, F.col("event_id").cast("string")).otherwise(F.lit(" "))
    zone = F.when(F.col("user_id") % 3 == 0, "Europe/Oslo").when(F.col("user_id") % 3 == 1, '"america/new_york"').otherwise("Mars/Olympus")
    wall = F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd'T'HHmmss")
    head = F.concat(
        F.lit("BEGIN:VEVENT\r\nUID:"), uid, F.lit("\r\nDTSTART;TZID="), zone, F.lit(":"), wall,
        F.lit("\r\nDURATION:PT"), (F.col("event_id") % 90).cast("string"),
        F.lit("M\r\nSUMMARY:not this\r\nsum\r\n mary:"), "event_type", F.lit("\r\n\t "), "props", F.lit("\nDESCRIPTION:a"),
    )
    tail = F.concat(F.lit("b "), "props", F.lit("\r\nEND:VEVENT\r\n"))
    blocks = e.select(
        F.col("event_type").alias("feed_id"),
        F.floor(F.col("event_id") / 200).alias("part"),
        "event_id",
        F.concat(F.hex(F.encode(head, "UTF-8")), F.lit("FF"), F.hex(F.encode(tail, "UTF-8"))).alias("block"),
    )
    listed = F.transform(F.sort_array(F.collect_list(F.struct("event_id", "block"))), lambda b: b["block"])
    docs = blocks.groupBy("feed_id", "part").agg(F.unhex(F.array_join(listed, "")).alias("content"))
    docs = docs.withColumn("snapshot_seq", F.lit(1).cast("bigint"))
    feeds = e.select(F.col("event_type").alias("feed_id")).distinct()
    events = normalised(decode(docs, feed_settings(feeds), zones(spark)))
    return events.select(
        "feed_id", "uid", "summary", "description", iso_ms(F.col("start")).alias("start"), iso_ms(F.col("end")).alias("end"), "hash"
    )
