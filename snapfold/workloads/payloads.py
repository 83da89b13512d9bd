"""Queries over texts and payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapfold.functions.digest import event_hash
from snapfold.functions.text import (
    describe_source,
    fingerprint,
    redact,
    truncate,
    unescape_text,
)
from snapfold.operators.batching import body_content, payload
from snapfold.operators.reconcile import shared_digests
from snapfold.operators.redaction import redact_by_table
from snapfold.sources.snapshots import escape_text
from snapfold.workloads.catalog import hash_sql, query, table


@query("text_unescape", "SELECT doc_id, text FROM documents")
def text_unescape(spark, sf_dir):
    """Escaping and unescaping whole texts gives them back."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", unescape_text(escape_text(F.col("text"))).alias("text")
    )


@query(
    "html_unescape",
    r"""
    SELECT page_id, md5(replace(replace(html, '/', chr(10)), '&', '')) AS digest FROM pages
    """,
)
def html_unescape(spark, sf_dir):
    r"""Pages with ``\n`` for every slash and a lone escape before every ampersand's letter."""
    html = F.replace(
        F.replace(F.col("html"), F.lit("/"), F.lit("\\n")), F.lit("&"), F.lit("")
    )
    marked = F.regexp_replace(html, r"([a-mo-z])", r"\\$1")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.md5(unescape_text(marked)).alias("digest")
    )


@query(
    "truncate_subject",
    """
    SELECT doc_id,
           CASE WHEN length(text) <= 255 THEN text ELSE substr(text, 1, 254) || chr(8230) END AS subject,
           CASE WHEN length(text) <= 8000 THEN text ELSE substr(text, 1, 7999) || chr(8230) END AS body
    FROM documents
    """,
)
def truncate_subject(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", truncate(text, 255).alias("subject"), truncate(text, 8000).alias("body")
    )


@query(
    "body_content",
    """
    SELECT page_id, md5(CASE WHEN contains(html, url) THEN html ELSE html || chr(10) || chr(10) || url END)
           AS digest,
           CASE WHEN contains(html, url) THEN '' ELSE url END AS tail
    FROM pages
    """,
)
def body_contents(spark, sf_dir):
    url = F.when(~F.contains("html", "url"), F.col("url"))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.md5(body_content(F.col("html"), F.col("url"))).alias("digest"),
        body_content(F.lit(""), url).alias("tail"),
    )


# Literals of different lengths, one inside another, and one too short to be replaced.
LITERALS = ["thtionth", "thtionthe", "of the and", "license", "token = ", "the"]


@query(
    "redact_documents",
    """
    SELECT doc_id,
           regexp_replace(text, 'of the and|thtionthe|thtionth|token = ', '[redacted]', 'g') AS text
    FROM documents
    """,
)
def redact_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", redact(F.col("text"), LITERALS).alias("text")
    )


_LITERALS = "SELECT substr(text, {0}, {1}) AS literal FROM benchmark"


@query(
    "redact_by_table",
    f"""
    WITH literals AS (
      {_LITERALS.format(1, 40)} UNION {_LITERALS.format(1, 20)} UNION {_LITERALS.format(11, 30)} UNION {_LITERALS.format(60, 9)}),
    pattern AS (
      SELECT string_agg(regexp_escape(literal), '|' ORDER BY length(literal) DESC) AS p FROM literals WHERE length(literal) >= 8)
    SELECT doc_id, regexp_replace(text, p, '[redacted]', 'g') AS text FROM documents, pattern
    """,
)
def redact_by_literals(spark, sf_dir):
    text = F.col("text")
    parts = [F.substring(text, a, n) for a, n in ((1, 40), (1, 20), (11, 30), (60, 9))]
    literals = table(spark, sf_dir, "benchmark").select(F.explode(F.array(*parts)).alias("literal"))
    return redact_by_table(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", literals)


@query("fingerprint", "SELECT doc_id, substr(sha256(text), 1, 8) AS print FROM documents")
def fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fingerprint(F.col("text")).alias("print"))


@query(
    "source_description",
    r"""
    SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+/[^?#]*)', 1) AS plain,
           CASE WHEN url LIKE 'https:%' THEN regexp_extract(url, '^(https://[^/?#]+)', 1) || '/'
                ELSE regexp_extract(url, '^(http://[^/?#]+)', 1) || ':443/' END AS with_port,
           '(no readable address)' AS broken
    FROM pages
    """,
)
def source_description(spark, sf_dir):
    url = F.col("url")
    host = F.regexp_extract(url, "^https?://([^/?#]+)", 1)
    scheme = F.regexp_extract(url, "^(https?)", 1)
    secret = F.concat(
        F.upper(scheme), F.lit("://me:secret@"), F.upper(host), F.lit(":443?token=abc#x")
    )
    return table(spark, sf_dir, "pages").select(
        "page_id",
        describe_source(url).alias("plain"),
        describe_source(secret).alias("with_port"),
        describe_source(F.regexp_replace(url, "://", "-")).alias("broken"),
    )


_ZONE = """CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Europe/Oslo' WHEN '2' THEN 'America/New_York'
           WHEN '3' THEN 'Asia/Kolkata' ELSE 'UTC' END"""
_ORDERS = f"""
ev AS (
  SELECT o_orderkey, {_ZONE} AS tz, o_orderstatus = 'F' AS is_all_day, o_orderpriority AS summary,
         CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus || ' order ' || o_orderkey END AS description,
         CASE WHEN o_totalprice >= 200000 THEN 'order ' || o_orderkey END AS url,
         o_orderdate + to_hours(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 20 END) AS "start",
         o_orderdate + to_hours(CASE WHEN o_orderstatus = 'F' THEN 24 ELSE 23 END) AS "end"
  FROM orders)
"""


@query(
    "payload_rows",
    f"""
    WITH {_ORDERS}
    SELECT o_orderkey, summary AS subject,
           concat_ws(chr(10) || chr(10), description,
                     CASE WHEN coalesce(contains(description, url), false) THEN NULL ELSE url END) AS content,
           CASE WHEN is_all_day THEN strftime("start", '%Y-%m-%dT00:00:00')
                ELSE strftime(timezone(tz, timezone('UTC', "start")), '%Y-%m-%dT%H:%M:%S') END AS starts,
           CASE WHEN is_all_day THEN strftime("end", '%Y-%m-%dT00:00:00')
                ELSE strftime(timezone(tz, timezone('UTC', "end")), '%Y-%m-%dT%H:%M:%S') END AS ends,
           tz AS zone, is_all_day, 'free' AS show_as, false AS reminder, 'TV' AS category,
           {hash_sql("CASE WHEN is_all_day THEN 'true' ELSE 'false' END")} AS transaction_id
    FROM ev
    """,
)
def payload_rows(spark, sf_dir):
    date = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    all_day = F.col("o_orderstatus") == "F"
    rank = F.substring("o_orderpriority", 1, 1)
    key = F.col("o_orderkey").cast("string")
    event = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(rank == "1", "Europe/Oslo")
        .when(rank == "2", "America/New_York")
        .when(rank == "3", "Asia/Kolkata")
        .otherwise("UTC")
        .alias("tz"),
        F.col("o_orderpriority").alias("summary"),
        F.when(
            F.col("o_orderstatus") != "P", F.concat("o_orderstatus", F.lit(" order "), key)
        ).alias("description"),
        F.when(F.col("o_totalprice") >= 200000, F.concat(F.lit("order "), key)).alias("url"),
        F.timestamp_seconds(date + F.when(all_day, 0).otherwise(20 * 3600)).alias("start"),
        F.timestamp_seconds(date + F.when(all_day, 24 * 3600).otherwise(23 * 3600)).alias("end"),
        all_day.alias("is_all_day"),
    )
    fields = ["summary", "description", "url", "start", "end", "is_all_day"]
    hashed = event.withColumn("hash", event_hash(*map(F.col, fields)))
    p = hashed.select("o_orderkey", payload(F.col("tz"), F.lit("TV")).alias("p"))
    return p.select(
        "o_orderkey",
        F.col("p.subject").alias("subject"),
        F.col("p.body.content").alias("content"),
        F.col("p.start.dateTime").alias("starts"),
        F.col("p.end.dateTime").alias("ends"),
        F.col("p.start.timeZone").alias("zone"),
        F.col("p.isAllDay").alias("is_all_day"),
        F.col("p.showAs").alias("show_as"),
        F.col("p.isReminderOn").alias("reminder"),
        F.col("p.categories")[0].alias("category"),
        F.col("p.transactionId").alias("transaction_id"),
    )


@query(
    "shared_digest_audit",
    f"""
    WITH ev AS (
      SELECT lang AS feed_id, CAST(doc_id AS VARCHAR) AS uid, text AS summary, NULL AS description,
             NULL AS url, TIMESTAMP '2024-01-01' AS "start", TIMESTAMP '2024-01-02' AS "end" FROM documents)
    SELECT feed_id, {hash_sql("'true'")} AS hash, count(*) AS uids, min(uid) AS first_uid
    FROM ev GROUP BY ALL HAVING count(*) > 1
    """,
)
def shared_digest_audit(spark, sf_dir):
    absent = F.lit(None).cast("string")
    digest = event_hash(
        F.col("text"),
        absent,
        absent,
        F.lit("2024-01-01").cast("timestamp"),
        F.lit("2024-01-02").cast("timestamp"),
        F.lit(True),
    )
    docs = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("feed_id"), F.col("doc_id").cast("string").alias("uid"), digest.alias("hash")
    )
    return shared_digests(docs)


