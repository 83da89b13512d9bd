"""Explicit schemas of every table; nothing is inferred."""

from __future__ import annotations

FEEDS = (
    "feed_id string, ics_url string, target_upn string, calendar_name string, event_category string, "
    "default_duration_minutes bigint, display_tz string, state_retention_days bigint, recent_limit bigint"
)

# The registry as operators type it in: every setting is text until it passed the rules.
RAW_FEEDS = (
    "feed_id string, ics_url string, target_upn string, calendar_name string, event_category string, "
    "default_duration_minutes string, display_tz string, state_retention_days string, recent_limit string"
)

DOCUMENTS = (
    "feed_id string, snapshot_seq bigint, snapshot_ts timestamp, part bigint, parts bigint, "
    "length bigint, content binary"
)

EVENTS = (
    "feed_id string, snapshot_seq bigint, uid string, feed_ord bigint, summary string, "
    "description string, url string, start timestamp, end timestamp, is_all_day boolean, hash string"
)

STATE = "feed_id string, uid string, event_id string, hash string, start string"

# The changes of a run: the state row a key has from then on (put), or that it has none (drop).
STATE_LOG = (
    "feed_id string, uid string, effect string, event_id string, hash string, start string, "
    "run_seq bigint, feed_bucket int"
)

FEED_STATE = (
    "feed_id string, version int, calendar_id string, last_sync_at timestamp, "
    "applied_snapshot_seq bigint, run_seq bigint"
)

RESPONSES = (
    "run_seq bigint, feed_id string, batch_id bigint, attempt int, id string, status int, "
    "body string, retry_after string"
)

RECENT = (
    "run_seq bigint, feed_id string, uid string, summary string, start string, added_at string, "
    "event_id string, ord bigint"
)

RUN_SUMMARY = (
    "run_seq bigint, feed_id string, created bigint, updated bigint, deleted bigint, skipped bigint, "
    "pruned bigint, errors bigint, aborted string"
)

TARGETS = "target_upn string, calendar_id string, name string, list_ord bigint"

ACTIONS = (
    "feed_id string, uid string, feed_ord bigint, summary string, description string, url string, "
    "start timestamp, end timestamp, is_all_day boolean, hash string, event_id string, "
    "stored_hash string, stored_start string, action string"
)

OUTBOX = (
    "feed_id string, batch_id bigint, op_ord bigint, id string, uid string, kind string, "
    "method string, url string, body string"
)

# Fields of a normalised event that travel with an operation.
EVENT_FIELDS = ["feed_ord", "summary", "description", "url", "start", "end", "is_all_day", "hash"]
