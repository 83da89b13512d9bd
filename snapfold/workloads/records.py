"""Queries over stored JSON, response bodies, the feed registry and whole runs."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from snapfold import schemas
from snapfold.functions.jsons import created_id, error_envelope
from snapfold.functions.status import failure_class, is_config_fault, is_feed_retryable, is_retryable
from snapfold.functions.zones import iso_ms, zones
from snapfold.operators.decode import last_wins
from snapfold.operators.registry import checked_feeds, registry_problems
from snapfold.operators.settle import backoff_ms
from snapfold.operators.targets import resolve_targets
from snapfold.plans.run import Store, run
from snapfold.session import scratch_dir
from snapfold.sources.batchlog import read_responses
from snapfold.sources.recent import revive_recent
from snapfold.sources.snapshots import ics_parts
from snapfold.sources.state import revive_state
from snapfold.workloads.catalog import all_feeds, feed_events, iso_sql, query, status_column, table, written
from snapfold.workloads.decoding import as_documents

# One stored blob per event. Blobs of errors have another version, large views are not JSON at all; of
# the four entries one is sound, one has a number for an id, one is a plain string, one a bad start.
_BLOB = """
b AS (
  SELECT event_id, user_id, ts, event_type <> 'error' AND NOT (event_type = 'view' AND value >= 100) AS usable,
         value >= 20 AS bad_start, event_type = 'signup' AS no_calendar, value < 5 AS no_sync FROM events)
"""


def _blobs(spark, sf_dir):
    def quoted(col):
        return F.concat(F.lit('"'), col, F.lit('"'))

    def joined(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    user = F.col("user_id").cast("string")
    start = quoted(iso_ms(F.col("ts").cast("timestamp")))
    doubtful = F.when(F.col("value") >= 20, F.lit('"nonsense"')).otherwise(start)
    good = joined('"a":{"eventId":"e-', user, '","hash":"h","start":', start, "}")
    number = joined('"b":{"eventId":5,"hash":"h","start":', start, "}")
    plain = joined('"c":"{\\"eventId\\":1}"')
    dated = joined('"":{},"d":{"eventId":"x","hash":"h","start":', doubtful, "}")
    version = F.when(F.col("event_type") == "error", F.lit("2")).otherwise(F.lit("1"))
    broken = (F.col("event_type") == "view") & (F.col("value") >= 100)
    calendar = F.when(F.col("event_type") == "signup", F.lit("7")).otherwise(F.lit('"cal"'))
    synced = F.when(F.col("value") < 5, F.lit('"never"')).otherwise(start)
    text = joined(
        '{"version":', version, ',"calendarId":', calendar, ',"lastSyncAt":', synced,
        ',"events":{', good, ",", number, ",", plain, ",", dated, "}}",
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("feed_id"),
        F.when(broken, F.concat(F.lit("x"), text)).otherwise(text).alias("json"),
    )


@query(
    "state_revive",
    f"""
    WITH {_BLOB}
    SELECT CAST(event_id AS VARCHAR) AS feed_id, 'a' AS uid, 'e-' || user_id AS event_id, 'h' AS hash,
           {iso_sql('ts')} AS "start" FROM b WHERE usable
    UNION ALL
    SELECT CAST(event_id AS VARCHAR), 'd', 'x', 'h', {iso_sql('ts')} FROM b WHERE usable AND NOT bad_start
    """,
)
def state_revive(spark, sf_dir):
    state, _, _ = revive_state(_blobs(spark, sf_dir))
    return state


@query(
    "state_headers",
    f"""
    WITH {_BLOB}
    SELECT CAST(event_id AS VARCHAR) AS feed_id, 1 AS version,
           CASE WHEN usable AND NOT no_calendar THEN 'cal' END AS calendar_id,
           CASE WHEN usable AND NOT no_sync THEN {iso_sql('ts')} ELSE '1970-01-01T00:00:00.000Z' END
           AS last_sync_at, NOT usable AS was_reset FROM b
    """,
)
def state_headers(spark, sf_dir):
    _, headers, _ = revive_state(_blobs(spark, sf_dir))
    return headers.withColumn("last_sync_at", iso_ms(F.col("last_sync_at")))


@query(
    "state_dropped",
    f"""
    WITH {_BLOB}
    SELECT CAST(event_id AS VARCHAR) AS feed_id, CAST(CASE WHEN bad_start THEN 4 ELSE 3 END AS BIGINT) AS dropped
    FROM b WHERE usable
    """,
)
def state_dropped(spark, sf_dir):
    return revive_state(_blobs(spark, sf_dir))[2]


@query(
    "recent_revive",
    """
    SELECT event_id, CAST(0 AS BIGINT) AS ord, CAST(user_id AS VARCHAR) AS uid, event_type AS summary, 's' AS "start",
           'a' AS added_at, 'e' AS stored_id,
           CASE WHEN value >= 30 THEN event_type ELSE 'unknown' END AS feed_id
    FROM events WHERE event_type <> 'error'
    """,
)
def recent_revive(spark, sf_dir):
    user = F.col("user_id").cast("string")
    feed = F.when(F.col("value") >= 30, F.concat(F.lit(',"feedId":"'), "event_type", F.lit('"')))
    entry = F.concat(
        F.lit('{"uid":"'), user, F.lit('","summary":"'), "event_type",
        F.lit('","start":"s","addedAt":"a","eventId":"e"'), F.coalesce(feed, F.lit("")), F.lit("}"),
    )
    broken = F.lit('{"uid":1,"summary":"x","start":"s","addedAt":"a","eventId":"e"},"text",null')
    entries = F.when(
        F.col("event_type") != "error", F.concat(F.lit("["), entry, F.lit(","), broken, F.lit("]"))
    ).otherwise('{"0":{}}')
    raw = table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit('{"version":1,"entries":'), entries, F.lit("}")).alias("json")
    )
    return revive_recent(raw.withColumnRenamed("event_id", "log_id")).withColumnsRenamed(
        {"event_id": "stored_id", "log_id": "event_id"}
    )


@query(
    "response_scan",
    """
    SELECT event_id, 'op-' || event_id AS id, 201 AS status, '{"id":"x"}' AS body,
           CAST(NULL AS VARCHAR) AS retry_after FROM events
    UNION ALL
    SELECT event_id, 'throttled', 429, NULL, CAST(user_id AS VARCHAR) FROM events
    """,
)
def response_scan(spark, sf_dir):
    key = F.col("event_id").cast("string")
    reply = F.concat(
        F.lit('{"responses":[{"id":"op-'), key,
        F.lit('","status":500},{"id":"huge","status":1e12},{"id":5,"status":200},{"id":"y","status":"200"},"z",{"id":"op-'),
        key,
        F.lit('","status":201,"body":{"id":"x"}},'),
        F.lit('{"id":"throttled","status":429,"body":null,"headers":{"Retry-After":"'),
        F.col("user_id").cast("string"), F.lit('"}}]}'),
    )
    raw = table(spark, sf_dir, "events").select("event_id", reply.alias("json"))
    return read_responses(raw)


@query(
    "error_envelope",
    """
    SELECT event_id,
           CASE event_type WHEN 'click' THEN 'E1' WHEN 'view' THEN 'E1' END AS code,
           CASE event_type WHEN 'click' THEN props WHEN 'error' THEN 'only a message' END AS message,
           CASE event_type WHEN 'signup' THEN 'new-' || user_id END AS created_id
    FROM events
    """,
)
def envelopes(spark, sf_dir):
    kind = F.col("event_type")
    escaped = F.replace(F.col("props"), F.lit('"'), F.lit('\\"'))
    body = (
        F.when(
            kind == "click",
            F.concat(F.lit('{"error":{"code":"E1","message":"'), escaped, F.lit('"},"id":""}')),
        )
        .when(kind == "view", '{"error":{"code":"E1","message":5}}')
        .when(kind == "error", '{"error":{"message":"only a message"}}')
        .when(kind == "signup", F.concat(F.lit('{"id":"new-'), F.col("user_id").cast("string"), F.lit('"}')))
        .otherwise("not json")
    )
    rows = table(spark, sf_dir, "events").withColumn("body", body)
    return rows.select("event_id", error_envelope(F.col("body")).alias("e"), created_id(F.col("body")).alias("created_id")).select(
        "event_id", "e.code", "e.message", "created_id"
    )


_STATUS = "CASE WHEN value < 10 THEN 200 + CAST(floor(value) AS INT) ELSE 390 + CAST(floor(value) AS INT) END"


@query(
    "failure_class",
    f"""
    WITH s AS (SELECT event_id, {_STATUS} AS status,
                      CASE event_type WHEN 'click' THEN 'create' WHEN 'view' THEN 'update' ELSE 'delete' END
                      AS kind FROM events)
    SELECT event_id, status,
           CASE WHEN status BETWEEN 200 AND 299 THEN NULL WHEN status = 404 AND kind <> 'create'
                THEN 'housekeeping' WHEN status IN (401, 403) THEN 'configuration' ELSE 'failure' END AS class,
           status IN (429, 500, 502, 503, 504) AS retry_sink, status IN (408, 429) OR status >= 500 AS retry_feed,
           status IN (401, 403) AS config_fault
    FROM s
    """,
)
def failure_classes(spark, sf_dir):
    whole = F.floor("value").cast("int")
    kind = (
        F.when(F.col("event_type") == "click", "create")
        .when(F.col("event_type") == "view", "update")
        .otherwise("delete")
    )
    status = F.when(F.col("value") < 10, whole + 200).otherwise(whole + 390)
    s = table(spark, sf_dir, "events").select("event_id", status.alias("status"), kind.alias("kind"))
    return s.select(
        "event_id",
        "status",
        failure_class(F.col("kind"), F.col("status")).alias("class"),
        is_retryable(F.col("status")).alias("retry_sink"),
        is_feed_retryable(F.col("status")).alias("retry_feed"),
        is_config_fault(F.col("status")).alias("config_fault"),
    )


@query(
    "backoff_delays",
    """
    SELECT event_id, CAST(least(20000, CASE event_type
      WHEN 'click' THEN floor(value) * 1000
      WHEN 'view' THEN greatest(date_diff('millisecond', TIMESTAMP '2024-01-15',
                                          date_trunc('second', ts)), 0)
      WHEN 'error' THEN greatest(date_diff('millisecond', TIMESTAMP '2024-01-15',
                                           date_trunc('millisecond', ts)), 0)
      WHEN 'signup' THEN 500 ELSE 2000 END) AS BIGINT) AS delay_ms
    FROM events
    """,
)
def backoff_delays(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    kind = F.col("event_type")
    header = (
        F.when(kind == "click", F.floor("value").cast("string"))
        .when(kind == "view", F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
        .when(kind == "error", iso_ms(ts))
        .when(kind == "signup", "soon")
    )
    tried = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == "signup", 1).otherwise(3).alias("attempt"),
        header.alias("retry_after"),
    )
    now = F.lit("2024-01-15").cast("timestamp")
    return tried.select(
        "event_id", backoff_ms(F.col("attempt"), F.col("retry_after"), now).alias("delay_ms")
    )


# Customers as registry rows. Segment and balance decide what is wrong with them.
_FEEDS = """
r AS (
  SELECT c_custkey, c_mktsegment AS seg, c_acctbal AS bal, c_nationkey AS nat,
         c_acctbal >= 2000 AND c_acctbal < 4000 AS odd FROM customer)
"""


def _raw_feeds(spark, sf_dir):
    seg, bal, nat = F.col("c_mktsegment"), F.col("c_acctbal"), F.col("c_nationkey")
    name = F.regexp_replace("c_name", "#", "-")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(seg == "BUILDING", F.concat(F.lit(" "), "c_name")).otherwise(name).alias("feed_id"),
        F.when(bal < 0, "  ")
        .when(bal < 1000, "not a url")
        .when(bal < 2000, "http://feeds.example.org/a")
        .otherwise(" https://feeds.example.org/a?t=1 ")
        .alias("ics_url"),
        F.when(nat == 0, F.lit(None).cast("string"))
        .when(nat == 1, "nobody")
        .when(nat == 2, "a b@example.org")
        .otherwise(F.concat(name, F.lit("@example.org")))
        .alias("target_upn"),
        F.when(nat < 12, " ").otherwise("Shows").alias("calendar_name"),
        F.lit(None).cast("string").alias("event_category"),
        F.when(bal >= 9000, "soon").when(bal >= 8000, "-5").otherwise(" 4.5e1 ").alias(
            "default_duration_minutes"
        ),
        F.when(nat == 3, "Mars/Olympus").when(nat == 4, "europe/oslo").otherwise("").alias("display_tz"),
        F.when((bal >= 2000) & (bal < 4000), "1.5")
        .when(bal >= 6000, "3000000000")
        .otherwise("0x1E")
        .alias("state_retention_days"),
        F.when(bal >= 9000, "0").otherwise("").alias("recent_limit"),
    )


_NUMBER_RULE = ": a whole number above zero is needed"


@query(
    "registry_problems",
    f"""
    WITH {_FEEDS}
    SELECT c_custkey, array_to_string(list_filter([
      CASE WHEN bal < 0 THEN 'ics_url: no feed address is given' END,
      CASE WHEN bal >= 0 AND bal < 1000 THEN 'ics_url: this is no absolute address' END,
      CASE WHEN bal >= 1000 AND bal < 2000 THEN 'ics_url: the scheme has to be https' END,
      CASE WHEN nat = 0 THEN 'target_upn: no calendar owner is given' END,
      CASE WHEN nat IN (1, 2) THEN 'target_upn: the owner has to be a mail address' END,
      CASE WHEN nat = 3 THEN 'display_tz: no time zone has this name' END,
      CASE WHEN seg = 'BUILDING' THEN 'feed_id: up to 64 small letters, digits, - and _ are allowed, a letter or digit first' END,
      CASE WHEN bal >= 8000 THEN 'default_duration_minutes{_NUMBER_RULE}' END,
      CASE WHEN odd THEN 'state_retention_days{_NUMBER_RULE}' END,
      CASE WHEN bal >= 9000 THEN 'recent_limit{_NUMBER_RULE}' END], lambda x: x IS NOT NULL), '; ') AS problems
    FROM r
    """,
)
def problems_of_registry(spark, sf_dir):
    found = registry_problems(_raw_feeds(spark, sf_dir), zones(spark))
    return found.select("c_custkey", F.array_join("problems", "; ").alias("problems"))


@query(
    "checked_registry",
    f"""
    WITH {_FEEDS}
    SELECT 'customer-' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS feed_id,
           'https://feeds.example.org/a?t=1' AS ics_url,
           'Customer-' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '@example.org' AS target_upn,
           CASE WHEN nat < 12 THEN 'TV' ELSE 'Shows' END AS calendar_name, 'TV' AS event_category,
           45 AS default_duration_minutes, CASE WHEN nat = 4 THEN 'Europe/Oslo' ELSE 'UTC' END AS display_tz,
           CASE WHEN bal >= 6000 THEN 3000000000 ELSE 30 END AS state_retention_days, 100 AS recent_limit
    FROM r WHERE bal >= 4000 AND bal < 8000 AND nat > 3 AND seg <> 'BUILDING'
    """,
)
def checked_registry(spark, sf_dir):
    return checked_feeds(_raw_feeds(spark, sf_dir).drop("c_custkey"), zones(spark))


# Suppliers as feeds; the customers of their nation are the calendars of the owner they write for.
@query(
    "target_resolution",
    """
    WITH f AS (
      SELECT CAST(s_suppkey AS VARCHAR) AS feed_id, s_nationkey AS owner,
             CASE WHEN s_acctbal > 5000 THEN 'BUILDING' WHEN s_acctbal > 0 THEN 'MACHINERY' ELSE 'Other' END AS nm,
             CASE WHEN s_acctbal > 2000 THEN s_suppkey END AS stored FROM supplier),
    named AS (
      SELECT c_nationkey AS owner, c_mktsegment AS nm, min(c_custkey) AS named_id FROM customer GROUP BY ALL)
    SELECT f.feed_id, 'cal-' || coalesce(k.c_custkey, n.named_id) AS calendar_id,
           CASE WHEN k.c_custkey IS NOT NULL THEN 'known' WHEN n.named_id IS NOT NULL THEN 'matched'
                ELSE 'missing' END AS resolution
    FROM f LEFT JOIN customer k ON k.c_custkey = f.stored AND k.c_nationkey = f.owner
    LEFT JOIN named n ON n.owner = f.owner AND n.nm = f.nm
    """,
)
def target_resolution(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    feed = F.col("s_suppkey").cast("string").alias("feed_id")
    bal = F.col("s_acctbal")
    feeds = s.select(
        feed,
        F.col("s_nationkey").cast("string").alias("target_upn"),
        F.when(bal > 5000, "BUILDING").when(bal > 0, "MACHINERY").otherwise("Other").alias("calendar_name"),
    )
    stored = F.when(bal > 2000, F.concat(F.lit("cal-"), F.col("s_suppkey").cast("string")))
    catalogue = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("string").alias("target_upn"),
        F.concat(F.lit("cal-"), F.col("c_custkey").cast("string")).alias("calendar_id"),
        F.col("c_mktsegment").alias("name"),
        F.col("c_custkey").alias("list_ord"),
    )
    return resolve_targets(feeds, s.select(feed, stored.alias("calendar_id")), catalogue)


def _answer(requests):
    """Answers of a service: one attempt, statuses as in the other queries, ids for new entries."""
    status = F.coalesce(status_column(1), F.lit(503))
    body = F.when(F.col("kind") == "create", F.concat(F.lit('{"id":"new-'), "uid", F.lit('"}')))
    return requests.select(
        "run_seq", "feed_id", "batch_id", F.lit(3).alias("attempt"), "id", status.alias("status"),
        body.alias("body"), F.lit(None).cast("string").alias("retry_after"),
    )


# Two runs over documents rendered from the events: the first half of the month, then the second.
@query(
    "two_runs",
    """
    WITH ev AS (
      SELECT event_type AS feed_id,
             CAST(user_id AS VARCHAR) || '-' || substr(regexp_extract(props, '[0-9]+'), 1, 1) AS uid,
             event_type || ' ' || props || coalesce(CASE WHEN value >= 50 THEN 'value, ' || props END, '')
               || date_trunc('second', ts) AS content,
             event_id, date_trunc('second', ts) AS starts_at FROM events),
    first AS (
      SELECT * FROM ev WHERE starts_at < TIMESTAMP '2024-01-16'
      QUALIFY row_number() OVER (PARTITION BY feed_id, uid ORDER BY event_id DESC) = 1),
    state AS (
      SELECT * FROM first WHERE substr(md5(feed_id || '/' || uid), 1, 1) IN
        ('0', '1', '2', '3', '4', '5', '6', '7', '8', '9')),
    second AS (
      SELECT * FROM ev WHERE starts_at >= TIMESTAMP '2024-01-11'
      QUALIFY row_number() OVER (PARTITION BY feed_id, uid ORDER BY event_id DESC) = 1),
    acts AS (
      SELECT coalesce(n.feed_id, s.feed_id) AS feed_id, coalesce(n.uid, s.uid) AS uid,
             CASE WHEN s.uid IS NULL THEN 'create' WHEN n.uid IS NOT NULL AND n.content <> s.content
                  THEN 'update' WHEN n.uid IS NOT NULL THEN 'unchanged'
                  WHEN s.starts_at > TIMESTAMP '2024-01-08' THEN 'delete'
                  WHEN s.starts_at < TIMESTAMP '2024-01-05' THEN 'prune' ELSE 'retain' END AS action
      FROM second n FULL JOIN state s ON n.feed_id = s.feed_id AND n.uid = s.uid),
    done AS (
      SELECT *, substr(md5(feed_id || '/' || uid), 1, 1) AS d FROM acts),
    out AS (
      SELECT *, d NOT IN ('a', 'b', 'c', 'd', 'e', 'f') AS ok, d = 'e' AS gone FROM done)
    SELECT feed_id, count(*) FILTER (action = 'create' AND ok) AS created,
           count(*) FILTER (action = 'update' AND ok) AS updated,
           count(*) FILTER (action = 'delete' AND (ok OR gone)) AS deleted,
           count(*) FILTER (action = 'unchanged') AS skipped, count(*) FILTER (action = 'prune') AS pruned,
           count(*) FILTER (NOT ok AND (action = 'create'
             OR (NOT gone AND action IN ('update', 'delete')))) AS errors,
           CAST(NULL AS VARCHAR) AS aborted, CASE WHEN count(*) FILTER (NOT ok AND (action = 'create'
             OR (NOT gone AND action IN ('update', 'delete')))) > 0 THEN 'degraded' ELSE 'ok' END AS level,
           1 AS run_seq
    FROM out GROUP BY feed_id
    """,
)
def two_runs(spark, sf_dir):
    """Each call keeps its tables in a folder of its own below the shared scratch folder."""
    # As many buckets as shuffle partitions: the base is never shuffled, and no join is held to fewer tasks.
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    store = Store(f"{scratch_dir(spark)}/snapfold-{uuid.uuid4().hex}", buckets)
    feeds = all_feeds(spark, sf_dir).select(
        "feed_id",
        F.lit("https://x.example.org/a").alias("ics_url"),
        F.lit("me@example.org").alias("target_upn"),
        F.lit("TV").alias("calendar_name"),
        F.lit("TV").alias("event_category"),
        F.lit(30).alias("default_duration_minutes"),
        F.when(F.col("feed_id") < "f", "Europe/Oslo").otherwise("UTC").alias("display_tz"),
        F.lit(3).alias("state_retention_days"),
        F.lit(100).alias("recent_limit"),
    )
    feeds = written(feeds)
    targets = spark.createDataFrame([("me@example.org", "cal", "TV", 0)], schemas.TARGETS)
    ev = feed_events(spark, sf_dir)
    summary = None
    shown = ["start < timestamp'2024-01-16'", "start >= timestamp'2024-01-11'"]
    for run_seq, window in enumerate(shown):
        events = last_wins(ev.where(window), ("feed_id", "uid")).withColumn("snapshot_seq", F.lit(run_seq).cast("bigint"))
        # Landed first, as a run reads its documents several times: their keys to choose and to gate, then the content.
        documents = written(as_documents(ics_parts(events, per_part=2000)))
        now = dt.datetime(2024, 1, 8)
        summary = run(spark, store, run_seq, now, documents, feeds, targets, _answer)
    return summary
