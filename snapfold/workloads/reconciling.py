"""Queries over snapshots and state: reconcile, gate, replay, batches, settlement, fold, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapfold.functions.digest import with_hash
from snapfold.operators.batching import (
    assign_batches,
    dispatch_counts,
    number_ops,
    operations,
    outbox,
)
from snapfold.operators.decode import last_wins
from snapfold.operators.fold import (
    aborted_summary,
    additions,
    advance_feed_state,
    feed_status,
    fold,
    outcomes,
    run_alerts,
    summarise,
)
from snapfold.operators.reconcile import (
    CHANGES,
    action_counts,
    gate,
    list_actions,
    reconcile,
    vanished,
)
from snapfold.operators.replay import replay
from snapfold.operators.settle import (
    longest_retry_after,
    operation_results,
    settle,
    settling_attempts,
)
from snapfold.functions.zones import iso_ms
from snapfold.sources.recent import recent, recent_page
from snapfold.sources.snapshots import newest_per_feed
from snapfold.sources.export import state_parts
from snapfold.workloads.catalog import (
    ACTIONS,
    EV,
    NOW,
    RETENTION_DAYS,
    SIDES,
    all_feeds,
    feed_events,
    hash_sql,
    iso_sql,
    query,
    run_clock,
    sides,
    status_column,
    status_sql,
    table,
    window_actions,
    written,
)


@query("event_digest", f"WITH {EV} SELECT feed_ord AS event_id, {hash_sql()} AS hash FROM ev")
def event_digest(spark, sf_dir):
    return with_hash(feed_events(spark, sf_dir)).select(F.col("feed_ord").alias("event_id"), "hash")


@query(
    "dedupe_last_wins",
    """
    WITH e AS (
      SELECT event_type AS feed_id, CAST(user_id AS VARCHAR) AS uid, event_id, value, props,
             min(event_id) OVER (PARTITION BY event_type, user_id) AS feed_ord
      FROM events)
    SELECT feed_id, uid, feed_ord, value, props FROM e
    QUALIFY row_number() OVER (PARTITION BY feed_id, uid ORDER BY event_id DESC) = 1
    """,
)
def dedupe_last_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("feed_id"),
        F.col("user_id").cast("string").alias("uid"),
        F.col("event_id").alias("feed_ord"),
        "value",
        "props",
    )
    return last_wins(e, ("feed_id", "uid"))


@query(
    "reconcile_actions",
    f"WITH {ACTIONS} SELECT feed_id, uid, action, event_id, hash, stored_hash FROM actions",
)
def reconcile_actions(spark, sf_dir):
    return window_actions(spark, sf_dir).select(
        "feed_id", "uid", "action", "event_id", "hash", "stored_hash"
    )


@query(
    "reconcile_summary",
    f"WITH {ACTIONS} SELECT feed_id, action, count(*) AS n FROM actions GROUP BY ALL",
)
def reconcile_summary(spark, sf_dir):
    return action_counts(window_actions(spark, sf_dir))


@query(
    "action_pages",
    f"""
    WITH {ACTIONS}, placed AS (
      SELECT feed_id, action, uid,
             row_number() OVER (PARTITION BY feed_id, action
                                ORDER BY substr(sha256(uid), 1, 3), uid) - 1 AS pos
      FROM actions)
    SELECT feed_id, action, CAST(floor(pos / 100) AS BIGINT) AS page, count(*) AS n,
           string_agg(uid, ' ' ORDER BY uid) AS uids
    FROM placed GROUP BY feed_id, action, page
    """,
)
def action_pages(spark, sf_dir):
    pages = list_actions(window_actions(spark, sf_dir), page_size=100)
    return pages.withColumn("uids", F.array_join("uids", " "))


@query(
    "vanished_keys",
    f"WITH {SIDES} SELECT feed_id, uid, event_id FROM stored ANTI JOIN fresh USING (feed_id, uid)",
)
def vanished_keys(spark, sf_dir):
    fresh, stored = sides(spark, sf_dir)
    return vanished(stored, fresh).select("feed_id", "uid", "event_id")


# One feed per customer: a poll of a customer in debt brought no document, an event of 150 or more has a
# malformed date, and most customers have no events at all.
_GATE = """
polled AS (
  SELECT CAST(c.c_custkey AS VARCHAR) AS feed_id,
         CASE WHEN any_value(c_acctbal) < 0 THEN 'ics-fetch-failed'
              WHEN coalesce(bool_or(value >= 150), false) THEN 'ics-parse-failed'
              WHEN count(e.event_id) = 0 THEN 'ics-feed-empty' END AS aborted,
         CASE WHEN any_value(c_acctbal) < 0 THEN 0 ELSE count(e.event_id) END AS events
  FROM customer c LEFT JOIN events e ON e.user_id = c.c_custkey GROUP BY ALL)
"""


def _polled(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    feed = F.col("c_custkey").cast("string").alias("feed_id")
    seq = F.lit(1).cast("bigint").alias("snapshot_seq")
    polls = c.select(feed, seq, F.lit(1).alias("parts"))
    arrived = c.where("c_acctbal >= 0").select(feed, seq, F.lit(0).alias("part"))
    decoded = (
        table(spark, sf_dir, "events")
        .select(
            F.col("user_id").cast("string").alias("feed_id"),
            seq,
            (F.col("value") >= 150).alias("bad"),
            F.lit(True).alias("kept"),
        )
        .join(arrived.select("feed_id"), "feed_id", "left_semi")
    )
    return gate(polls, arrived, decoded)


@query("snapshot_gate", f"WITH {_GATE} SELECT feed_id, aborted, events FROM polled")
def snapshot_gate(spark, sf_dir):
    return _polled(spark, sf_dir).select("feed_id", "aborted", "events")


@query(
    "reconcile_gated",
    f"""
    WITH {_GATE},
    e AS (
      SELECT CAST(user_id AS VARCHAR) AS feed_id,
             event_type || '-' || substr(regexp_extract(props, '[0-9]+'), 1, 1) AS uid,
             ts, event_id, props FROM events),
    stored AS (
      SELECT feed_id, uid, props, ts FROM e WHERE ts < TIMESTAMP '2024-01-20'
      QUALIFY row_number() OVER (PARTITION BY feed_id, uid ORDER BY event_id DESC) = 1),
    fresh AS (
      SELECT feed_id, uid, props, ts FROM e WHERE ts >= TIMESTAMP '2024-01-14'
      QUALIFY row_number() OVER (PARTITION BY feed_id, uid ORDER BY event_id DESC) = 1),
    acts AS (
      SELECT coalesce(f.feed_id, s.feed_id) AS feed_id,
             CASE WHEN s.uid IS NULL THEN 'create'
                  WHEN f.uid IS NOT NULL AND f.props <> s.props THEN 'update'
                  WHEN f.uid IS NOT NULL THEN 'unchanged'
                  WHEN date_trunc('milliseconds', s.ts) > TIMESTAMP '{NOW}' THEN 'delete'
                  WHEN date_trunc('milliseconds', s.ts)
                       < TIMESTAMP '{NOW}' - INTERVAL {RETENTION_DAYS} DAY THEN 'prune'
                  ELSE 'retain' END AS action
      FROM fresh f FULL JOIN stored s ON f.feed_id = s.feed_id AND f.uid = s.uid)
    SELECT feed_id, action, CAST(NULL AS VARCHAR) AS aborted, count(*) AS n
    FROM acts JOIN polled USING (feed_id) WHERE aborted IS NULL GROUP BY feed_id, action
    UNION ALL
    SELECT feed_id, 'none', aborted, 0 FROM polled WHERE aborted IS NOT NULL
    """,
)
def reconcile_gated(spark, sf_dir):
    gated = _polled(spark, sf_dir)
    start = F.col("ts").cast("timestamp")
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("feed_id"),
        F.concat(
            "event_type", F.lit("-"), F.substring(F.regexp_extract("props", "[0-9]+", 0), 1, 1)
        ).alias("uid"),
        F.col("event_id").alias("feed_ord"),
        F.lit(None).cast("string").alias("summary"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("url"),
        start.alias("start"),
        start.alias("end"),
        F.lit(False).alias("is_all_day"),
        F.col("props").alias("hash"),
    )
    key = ("feed_id", "uid")
    stored = last_wins(e.where("start < timestamp'2024-01-20'"), key).select(
        *key, F.concat(F.lit("id-"), "uid").alias("event_id"), "hash", iso_ms(F.col("start")).alias("start")
    )
    fresh = last_wins(e.where("start >= timestamp'2024-01-14'"), key)
    usable = run_clock(gated.where(F.col("aborted").isNull()))
    counts = action_counts(reconcile(fresh, stored, usable))
    rejected = gated.where(F.col("aborted").isNotNull())
    return counts.withColumn("aborted", F.lit(None).cast("string")).unionByName(
        rejected.select(
            "feed_id", F.lit("none").alias("action"), "aborted", F.lit(0).cast("bigint").alias("n")
        )
    )


# Daily polls of a feed per event type; an event starts some hours (its value) after it was seen.
@query(
    "replay_history",
    """
    WITH obs AS (
      SELECT event_type AS feed_id, CAST(user_id AS VARCHAR) AS uid, CAST(ts AS DATE) AS day,
             props AS hash, ts + to_hours(CAST(floor(value) AS INT)) AS "start"
      FROM events
      QUALIFY row_number() OVER (PARTITION BY event_type, user_id, CAST(ts AS DATE)
                                 ORDER BY event_id DESC) = 1),
    line AS (
      SELECT feed_id, day, day + INTERVAL 1 DAY AS now_at,
             row_number() OVER (PARTITION BY feed_id ORDER BY day) AS k,
             count(*) OVER (PARTITION BY feed_id) AS polls
      FROM (SELECT DISTINCT feed_id, day FROM obs)),
    seen AS (
      SELECT o.*, l.k, l.polls, lag(l.k) OVER w AS lag_k, lag(hash) OVER w AS lag_hash,
             lag("start") OVER w AS lag_start, coalesce(lead(l.k) OVER w, l.polls + 1) AS n
      FROM obs o JOIN line l USING (feed_id, day)
      WINDOW w AS (PARTITION BY o.feed_id, o.uid ORDER BY l.k)),
    gaps AS (
      SELECT s.feed_id, s.uid, s.k, s.n, nx.now_at AS next_now, s."start",
             (SELECT min(p.k) FROM line p WHERE p.feed_id = s.feed_id AND p.k BETWEEN s.k + 1 AND s.n - 1
              AND p.now_at - INTERVAL 3 DAY > s."start") AS prune_k
      FROM seen s JOIN line nx ON nx.feed_id = s.feed_id AND nx.k = s.k + 1 WHERE s.n > s.k + 1),
    ends AS (
      SELECT feed_id, uid, k, n,
             CASE WHEN "start" > next_now THEN 'delete' WHEN prune_k IS NOT NULL THEN 'prune' END AS action,
             CASE WHEN "start" > next_now THEN k + 1 ELSE prune_k END AS at_k
      FROM gaps),
    acts AS (
      SELECT s.feed_id, s.uid, s.k AS at_k,
             CASE WHEN s.lag_k IS NULL OR e.action IS NOT NULL THEN 'create'
                  WHEN s.lag_hash <> s.hash THEN 'update' ELSE 'unchanged' END AS action
      FROM seen s LEFT JOIN ends e ON e.feed_id = s.feed_id AND e.uid = s.uid AND e.k = s.lag_k
      UNION ALL
      SELECT feed_id, uid, at_k, action FROM ends WHERE action IS NOT NULL)
    SELECT a.feed_id, a.uid, CAST(date_diff('day', DATE '2024-01-01', l.day) AS BIGINT) AS snapshot_seq, a.action
    FROM acts a JOIN line l ON l.feed_id = a.feed_id AND l.k = a.at_k
    """,
)
def replay_history(spark, sf_dir):
    observed = history(spark, sf_dir)
    # Every feed is polled on every day on which it has an event.
    timeline = daily_polls(observed, retention_days=3)
    return replay(observed, timeline)


def history(spark, sf_dir) -> DataFrame:
    """Daily observations of (event type, user)."""
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("bigint")
    seen = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("feed_id"),
        day.alias("snapshot_seq"),
        F.col("user_id").cast("string").alias("uid"),
        F.col("event_id").alias("feed_ord"),
        F.col("props").alias("hash"),
        F.timestamp_micros(
            F.unix_micros(F.col("ts").cast("timestamp")) + F.floor("value") * 3_600_000_000
        ).alias("start"),
    )
    return last_wins(seen)


def daily_polls(observed: DataFrame, retention_days: int) -> DataFrame:
    midnight = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("snapshot_seq") + 1).cast("int"))
    return (
        observed.select("feed_id", "snapshot_seq")
        .distinct()
        .withColumn("now", midnight.cast("timestamp"))
        .withColumn("state_retention_days", F.lit(retention_days))
    )


_OPS = f"""
{ACTIONS},
ops AS (
  SELECT feed_id, uid, action AS kind, event_id, feed_ord, hash, "start", "end", summary, description, url,
         row_number() OVER (PARTITION BY feed_id ORDER BY
           CASE action WHEN 'create' THEN 0 WHEN 'update' THEN 1 ELSE 2 END, feed_ord,
           substr(sha256(uid), 1, 3), uid) - 1 AS op_ord
  FROM actions WHERE action IN ('create', 'update', 'delete')),
requests AS MATERIALIZED (
  SELECT *, CAST(floor(op_ord / 20) AS BIGINT) AS batch_id, 'op-' || op_ord AS id FROM ops)
"""


def _requests(actions: DataFrame) -> DataFrame:
    """Numbered operations; as in a run the actions are a written table, because they are read often."""
    numbered = assign_batches(number_ops(operations(actions)))
    return numbered.withColumn("run_seq", F.lit(1).cast("bigint"))


def _written_actions(spark, sf_dir) -> DataFrame:
    return written(window_actions(spark, sf_dir))


@query("op_batches", f"WITH {_OPS} SELECT feed_id, uid, kind, op_ord, batch_id, id FROM requests")
def op_batches(spark, sf_dir):
    requests = _requests(_written_actions(spark, sf_dir))
    return requests.select("feed_id", "uid", "kind", "op_ord", "batch_id", "id")


@query(
    "dispatch_counts",
    f"""
    WITH {_OPS} SELECT feed_id, count(*) AS requests, CAST(ceil(count(*) / 20) AS BIGINT) AS batches
    FROM ops GROUP BY feed_id
    """,
)
def dispatched(spark, sf_dir):
    return dispatch_counts(operations(window_actions(spark, sf_dir)))


@query(
    "outbox_rows",
    f"""
    WITH {_OPS}, z AS (
      SELECT *, '/users/' || feed_id || '%40example.org' AS usr,
             CASE feed_id WHEN 'click' THEN 'America/New_York' WHEN 'view' THEN 'Asia/Kolkata'
                          ELSE 'Europe/Oslo' END AS tz
      FROM requests),
    p AS (
      SELECT *, {{'subject': summary,
        'body': {{'contentType': 'text', 'content': concat_ws(chr(10) || chr(10), description, url)}},
        'start': {{'dateTime': strftime(timezone(tz, timezone('UTC', "start")), '%Y-%m-%dT%H:%M:%S'),
                  'timeZone': tz}},
        'end': {{'dateTime': strftime(timezone(tz, timezone('UTC', "end")), '%Y-%m-%dT%H:%M:%S'),
                'timeZone': tz}},
        'isAllDay': false, 'showAs': 'free', 'isReminderOn': false, 'categories': ['TV']}} AS upd
      FROM z)
    SELECT feed_id, batch_id, id, uid, kind,
           CASE kind WHEN 'create' THEN 'POST' WHEN 'update' THEN 'PATCH' ELSE 'DELETE' END AS method,
           CASE kind WHEN 'create' THEN usr || '/calendars/cal%20' || feed_id || '/events'
                     ELSE usr || '/events/' || event_id END AS url,
           CASE kind WHEN 'create'
                     THEN CAST(to_json(struct_insert(upd, transactionId := hash)) AS VARCHAR)
                     WHEN 'update' THEN CAST(to_json(upd) AS VARCHAR) END AS body
    FROM p
    """,
)
def outbox_rows(spark, sf_dir):
    zone = (
        F.when(F.col("feed_id") == "click", "America/New_York")
        .when(F.col("feed_id") == "view", "Asia/Kolkata")
        .otherwise("Europe/Oslo")
    )
    targets = all_feeds(spark, sf_dir).select(
        "feed_id",
        F.concat("feed_id", F.lit("@example.org")).alias("target_upn"),
        F.concat(F.lit("cal "), "feed_id").alias("calendar_id"),
        zone.alias("display_tz"),
        F.lit("TV").alias("event_category"),
    )
    return outbox(_requests(_written_actions(spark, sf_dir)), targets, 1).drop("run_seq", "op_ord")


# Attempts of the operations: a response per attempt up to the third, some of them missing.
_ATTEMPTS = f"""
{_OPS},
attempts AS MATERIALIZED (
  SELECT feed_id, batch_id, id, uid, kind, unnest([1, 2, 3]) AS attempt,
         unnest([{status_sql(1)}, {status_sql(2)}, {status_sql(3)}]) AS status
  FROM requests r),
responses AS MATERIALIZED (
  SELECT a.feed_id, a.batch_id, a.id, a.uid, a.kind, a.attempt, a.status,
         CASE WHEN a.status = 200 AND substr(md5(a.feed_id || '/' || a.uid), 9, 1) <> '0'
              THEN '{{"id":"new-' || a.uid || '"}}'
              WHEN a.status = 200 THEN '{{}}'
              ELSE '{{"error":{{"code":"E' || a.status || '","message":"attempt ' || a.attempt || '"}}}}'
         END AS body,
         CASE a.status WHEN 429 THEN substr(a.uid, 1, 1) WHEN 503 THEN 'soon' END AS retry_after
  FROM attempts a WHERE a.status IS NOT NULL),
answers AS MATERIALIZED (
  SELECT feed_id, batch_id, id, min(attempt) AS settled_attempt,
         arg_min(status, attempt) AS status, arg_min(body, attempt) AS body
  FROM responses WHERE status NOT IN (429, 500, 502, 503, 504) OR attempt = 3 GROUP BY ALL),
settled AS MATERIALIZED (
  SELECT r.feed_id, r.batch_id, r.id, r.uid, r.kind, a.settled_attempt, coalesce(a.status, 503) AS status,
         coalesce(a.body, '{{"error":{{"code":"batchRetriesExhausted"}}}}') AS body
  FROM requests r LEFT JOIN answers a USING (feed_id, batch_id, id)),
results AS MATERIALIZED (
  SELECT feed_id, uid, kind,
         CASE WHEN status = 200 AND kind = 'create' THEN json_extract_string(body, '$.id') END AS event_id,
         CASE WHEN status <> 200 THEN json_extract_string(body, '$.error.message') END AS error,
         CASE WHEN status = 200 AND kind = 'create' AND json_extract_string(body, '$.id') IS NULL
              THEN 502 ELSE status END AS status
  FROM settled),
outcomes AS MATERIALIZED (
  SELECT a.*, r.status, r.kind, r.event_id AS new_id,
         CASE WHEN r.kind IS NULL THEN NULL
              WHEN r.kind = 'create' THEN CASE WHEN r.status = 200 THEN 'created' ELSE 'error' END
              WHEN r.kind = 'update' THEN CASE WHEN r.status = 404 THEN 'vanished'
                                               WHEN r.status = 200 THEN 'updated' ELSE 'error' END
              WHEN r.status IN (200, 404) THEN 'deleted' ELSE 'error' END AS outcome
  FROM actions a LEFT JOIN results r USING (feed_id, uid))
"""


def _responses(requests: DataFrame) -> DataFrame:
    def attempt(n: int):
        return F.struct(F.lit(n).alias("attempt"), status_column(n).alias("status"))

    status = F.col("status").cast("string")
    new_id = F.concat(F.lit('{"id":"new-'), "uid", F.lit('"}'))
    error = F.concat(
        F.lit('{"error":{"code":"E'),
        status,
        F.lit('","message":"attempt '),
        F.col("attempt").cast("string"),
        F.lit('"}}'),
    )
    has_id = F.substring(F.md5(F.concat("feed_id", F.lit("/"), "uid")), 9, 1) != "0"
    return (
        requests.select("run_seq", "feed_id", "batch_id", "id", "uid", F.inline(F.array(*map(attempt, (1, 2, 3)))))
        .where(F.col("status").isNotNull())
        .withColumn(
            "body",
            F.when((F.col("status") == 200) & has_id, new_id)
            .when(F.col("status") == 200, "{}")
            .otherwise(error),
        )
        .withColumn(
            "retry_after",
            F.when(F.col("status") == 429, F.substring("uid", 1, 1)).when(
                F.col("status") == 503, "soon"
            ),
        )
        .drop("uid")
    )


def _results(actions: DataFrame) -> DataFrame:
    requests = _requests(actions)
    return operation_results(settle(requests, _responses(requests)))


@query(
    "settle_attempts",
    f"WITH {_ATTEMPTS} SELECT feed_id, batch_id, id, uid, kind, settled_attempt, status, body FROM settled",
)
def settle_attempts(spark, sf_dir):
    requests = _requests(_written_actions(spark, sf_dir))
    return settle(requests, _responses(requests)).drop("run_seq")


@query(
    "operation_results",
    f"""
    WITH {_ATTEMPTS}
    SELECT feed_id, uid, kind, status = 200 AS ok, status, event_id, error FROM results
    """,
)
def results_of_operations(spark, sf_dir):
    return _results(_written_actions(spark, sf_dir)).drop("run_seq")


@query(
    "retry_after_max",
    f"""
    WITH {_ATTEMPTS}
    SELECT r.feed_id, r.batch_id, r.attempt, count(*) AS sent_again,
           max(TRY_CAST(r.retry_after AS DOUBLE)) AS retry_after_s
    FROM responses r LEFT JOIN answers a USING (feed_id, batch_id, id)
    WHERE r.status IN (429, 500, 502, 503, 504) AND r.attempt < 3
      AND (a.settled_attempt IS NULL OR a.settled_attempt > r.attempt)
    GROUP BY ALL
    """,
)
def retry_after_max(spark, sf_dir):
    responses = _responses(_requests(_written_actions(spark, sf_dir)))
    return longest_retry_after(responses, settling_attempts(responses)).drop("run_seq")


@query(
    "fold_state",
    f"""
    WITH {_ATTEMPTS}
    SELECT feed_id, uid,
           CASE WHEN outcome = 'created' THEN new_id ELSE event_id END AS event_id,
           CASE WHEN outcome IN ('created', 'updated') THEN hash ELSE stored_hash END AS hash,
           CASE WHEN outcome IN ('created', 'updated') THEN {iso_sql('"start"')}
                ELSE stored_start END AS "start"
    FROM outcomes
    WHERE coalesce(outcome, '') NOT IN ('deleted', 'vanished') AND action <> 'prune'
      AND (event_id IS NOT NULL OR outcome = 'created')
    """,
)
def fold_state(spark, sf_dir):
    fresh, stored = sides(spark, sf_dir)
    actions = written(reconcile(fresh, stored, run_clock(all_feeds(spark, sf_dir))))
    changes = actions.where(F.col("action").isin(*CHANGES))
    return fold(stored, outcomes(changes, _results(actions)))


_SUMMARY = """
  count(*) FILTER (outcome = 'created') AS created, count(*) FILTER (outcome = 'updated') AS updated,
  count(*) FILTER (outcome = 'deleted') AS deleted, count(*) FILTER (action = 'unchanged') AS skipped,
  count(*) FILTER (action = 'prune') AS pruned, count(*) FILTER (outcome = 'error') AS errors
"""


@query(
    "run_summary",
    f"""
    WITH {_ATTEMPTS}, counted AS (SELECT feed_id, {_SUMMARY} FROM outcomes GROUP BY feed_id), {_GATE}
    SELECT *, NULL AS aborted, CASE WHEN errors > 0 THEN 'degraded' ELSE 'ok' END AS level FROM counted
    UNION ALL
    SELECT feed_id, 0, 0, 0, 0, 0, 1, aborted, 'aborted' FROM polled WHERE aborted IS NOT NULL
    """,
)
def run_summary(spark, sf_dir):
    actions = _written_actions(spark, sf_dir)
    settled = outcomes(actions, _results(actions))
    rejects = _polled(spark, sf_dir).where(F.col("aborted").isNotNull())
    return run_alerts(summarise(settled).unionByName(aborted_summary(rejects)))


@query(
    "new_additions",
    f"""
    WITH {_ATTEMPTS}
    SELECT feed_id, uid, summary, {iso_sql('"start"')} AS "start", '2024-01-12T00:00:00.000Z' AS added_at,
           new_id AS event_id, feed_ord AS ord
    FROM outcomes WHERE outcome = 'created'
    """,
)
def new_additions(spark, sf_dir):
    actions = _written_actions(spark, sf_dir)
    settled = outcomes(actions, _results(actions))
    return additions(settled, F.lit("2024-01-12T00:00:00.000Z"))


# The recent log: every event was added by the run of its day.
_LOG = f"""
log AS (
  SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS run_seq,
         event_type AS feed_id, CAST(event_id AS VARCHAR) AS uid, props AS summary,
         {iso_sql("ts + to_hours(CAST(floor(value) AS INT))")} AS "start", event_id AS ord
  FROM events)
"""
_NEWEST = 'ORDER BY run_seq DESC, "start" DESC, feed_id, ord, uid'


def _log(spark, sf_dir) -> DataFrame:
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("bigint")
    start = F.timestamp_micros(
        F.unix_micros(F.col("ts").cast("timestamp")) + F.floor("value") * 3_600_000_000
    )
    return table(spark, sf_dir, "events").select(
        day.alias("run_seq"),
        F.col("event_type").alias("feed_id"),
        F.col("event_id").cast("string").alias("uid"),
        F.col("props").alias("summary"),
        iso_ms(start).alias("start"),
        F.col("event_id").alias("ord"),
    )


@query("recent_top_n", f"WITH {_LOG} SELECT * FROM log {_NEWEST} LIMIT 5000")
def recent_top_n(spark, sf_dir):
    return recent(_log(spark, sf_dir), 5000)


@query(
    "recent_page",
    f"""
    WITH {_LOG}, view AS (SELECT * FROM log {_NEWEST} LIMIT 300)
    SELECT *, (SELECT count(*) FROM view) AS count FROM view {_NEWEST} LIMIT 120
    """,
)
def page_of_recent(spark, sf_dir):
    return recent_page(_log(spark, sf_dir), "120.9", configured=300)


@query(
    "feed_status",
    f"""
    WITH {SIDES}, head AS (
      SELECT event_type AS feed_id, max(ts) AS last_sync_at FROM events WHERE event_type <> 'error' GROUP BY 1)
    SELECT c.feed_id, 'TV' AS calendar_name,
           coalesce(c.feed_id NOT IN ('view', 'error'), false) AS calendar_resolved,
           count(s.uid) AS tracked_events,
           coalesce({iso_sql("any_value(h.last_sync_at)")}, '1970-01-01T00:00:00.000Z') AS last_sync_at
    FROM (SELECT DISTINCT event_type AS feed_id FROM events) c
    LEFT JOIN stored s USING (feed_id) LEFT JOIN head h ON h.feed_id = c.feed_id GROUP BY c.feed_id
    """,
)
def status_of_feeds(spark, sf_dir):
    _, stored = sides(spark, sf_dir)
    e = table(spark, sf_dir, "events")
    heads = (
        e.where("event_type <> 'error'")
        .groupBy(F.col("event_type").alias("feed_id"))
        .agg(F.max("ts").cast("timestamp").alias("last_sync_at"))
        .withColumn("calendar_id", F.when(F.col("feed_id") != "view", F.concat(F.lit("cal-"), "feed_id")))
    )
    feeds = all_feeds(spark, sf_dir).withColumn("calendar_name", F.lit("TV"))
    return feed_status(stored, heads, feeds)


@query(
    "feed_state_upkeep",
    f"""
    WITH {_GATE}
    SELECT feed_id, 1 AS version,
           CASE WHEN aborted IS NULL THEN 'cal-new' ELSE 'cal-old' END AS calendar_id,
           CASE WHEN aborted IS NULL THEN '2024-02-01T00:00:00.000Z'
                ELSE '2024-01-01T00:00:00.000Z' END AS last_sync_at,
           CASE WHEN aborted IS NULL THEN 2 ELSE 1 END AS applied_snapshot_seq
    FROM polled
    """,
)
def feed_state_upkeep(spark, sf_dir):
    def header(df, calendar, at, seq):
        return df.select(
            "feed_id",
            F.lit(1).alias("version"),
            F.lit(calendar).alias("calendar_id"),
            F.lit(at).cast("timestamp").alias("last_sync_at"),
            F.lit(seq).alias("applied_snapshot_seq"),
        )

    gated = _polled(spark, sf_dir)
    before = header(gated, "cal-old", "2024-01-01 00:00:00", 1)
    finished = header(gated.where(F.col("aborted").isNull()), "cal-new", "2024-02-01 00:00:00", 2)
    after = advance_feed_state(before, finished)
    return after.withColumn("last_sync_at", iso_ms(F.col("last_sync_at")))


@query(
    "newest_snapshots",
    """
    WITH docs AS (
      SELECT CAST(user_id AS VARCHAR) AS feed_id,
             CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS snapshot_seq, event_id
      FROM events),
    applied AS (
      SELECT CAST(c_custkey AS VARCHAR) AS feed_id, CAST(floor(c_acctbal / 200) AS BIGINT) AS seq FROM customer),
    newest AS (SELECT feed_id, max(snapshot_seq) AS snapshot_seq FROM docs GROUP BY feed_id)
    SELECT d.feed_id, d.snapshot_seq, d.event_id FROM docs d JOIN newest USING (feed_id, snapshot_seq)
    LEFT JOIN applied a ON a.feed_id = d.feed_id WHERE d.snapshot_seq > coalesce(a.seq, -1)
    """,
)
def newest_snapshots(spark, sf_dir):
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("bigint")
    docs = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("feed_id"),
        day.alias("snapshot_seq"),
        F.col("event_id").alias("part"),
    )
    applied = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("feed_id"),
        F.floor(F.col("c_acctbal") / 200).alias("applied_snapshot_seq"),
    )
    # Every user is registered, so the registry leaves all of them in.
    return newest_per_feed(docs, applied, docs).withColumnRenamed("part", "event_id")


@query(
    "state_export",
    f"""
    WITH {SIDES},
    placed AS (
      SELECT *, CAST('0x' || substr(sha256(uid), 1, 6) AS BIGINT) AS place, count(*) OVER (PARTITION BY feed_id) AS n FROM stored),
    bodies AS (
      SELECT feed_id, CAST(floor(place * ceil(n / 200.0) / 16777216) AS BIGINT) AS cut,
             string_agg(to_json(uid) || ':' || to_json({{'eventId': event_id, 'hash': hash, 'start': "start"}}), ',' ORDER BY place, uid) AS body
      FROM placed GROUP BY ALL),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY cut) AS part FROM bodies),
    heads AS (
      SELECT f.feed_id, 'cal-' || f.feed_id AS cal, coalesce(max(part), 0) + 1 AS last
      FROM (SELECT DISTINCT event_type AS feed_id FROM events) f LEFT JOIN numbered USING (feed_id) GROUP BY ALL)
    SELECT feed_id, part, CASE WHEN part > 1 THEN ',' ELSE '' END || body AS text FROM numbered
    UNION ALL
    SELECT feed_id, 0, '{{"version":1,"calendarId":"' || cal || '","lastSyncAt":"2024-01-01T00:00:00.000Z","events":{{' FROM heads
    UNION ALL SELECT feed_id, last, '}}}}' FROM heads
    """,
)
def state_export(spark, sf_dir):
    headers = all_feeds(spark, sf_dir).select(
        "feed_id", F.concat(F.lit("cal-"), "feed_id").alias("calendar_id"), F.lit("2024-01-01").cast("timestamp").alias("last_sync_at")
    )
    return state_parts(sides(spark, sf_dir)[1], headers, per_part=200)
