"""From logged attempts to one result per operation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapfold.functions.jsons import created_id, error_envelope
from snapfold.functions.status import (
    BASE_BACKOFF_MS,
    MAX_ATTEMPTS,
    MAX_BACKOFF_MS,
    NO_ID,
    UNSETTLED,
    is_ok,
    is_retryable,
)
from snapfold.functions.text import js_number
from snapfold.functions.zones import parse_iso

REQUEST_KEY = ["run_seq", "feed_id", "batch_id", "id"]
HTTP_DATE = r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$"
# Fixed value: body of a request that no attempt settled.
EXHAUSTED = '{"error":{"code":"batchRetriesExhausted"}}'


def settling_attempts(responses: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Per request the first response that ends it: not retryable, or the last attempt's.

    Aggregated with a map-side step on the request key.
    """
    final = ~is_retryable(F.col("status")) | (F.col("attempt") == max_attempts)
    return (
        responses.where(final & (F.col("attempt") <= max_attempts))
        .groupBy(*REQUEST_KEY)
        .agg(
            F.min("attempt").alias("settled_attempt"),
            F.min_by(F.struct("status", "body"), F.col("attempt")).alias("__answer"),
        )
        .select(*REQUEST_KEY, "settled_attempt", "__answer.*")
    )


def match_responses(requests: DataFrame, settled: DataFrame) -> DataFrame:
    """Requests with their answer, matched by id and never by position; unanswered ones get 503."""
    return (
        requests.join(settled, REQUEST_KEY, "left")
        .withColumn("body", F.when(F.col("status").isNull(), EXHAUSTED).otherwise(F.col("body")))
        .withColumn("status", F.coalesce("status", F.lit(UNSETTLED)))
    )


def settle(requests: DataFrame, responses: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """One row per request with final ``status`` and ``body``."""
    slim = requests.select(*REQUEST_KEY, "uid", "kind")
    return match_responses(slim, settling_attempts(responses, max_attempts))


def unmatched(requests: DataFrame, responses: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """(feed_id, unmatched): per requested feed the answers that end a request nobody made; each is an error."""
    strange = settling_attempts(responses, max_attempts).join(requests.select(*REQUEST_KEY), REQUEST_KEY, "left_anti")
    counted = strange.groupBy("feed_id").agg(F.count(F.lit(1)).alias("unmatched"))
    return counted.join(requests.select("feed_id").distinct(), "feed_id", "left_semi")


def operation_results(answers: DataFrame) -> DataFrame:
    """Settled answers as results; a successful create without an id is a failure with status 502."""
    status = F.col("status")
    new_id = F.when(F.col("kind") == "create", created_id(F.col("body")))
    no_id = is_ok(status) & (F.col("kind") == "create") & F.col("event_id").isNull()
    message = F.when(~is_ok(status), error_envelope(F.col("body")).message)
    return (
        answers.withColumn("event_id", F.when(is_ok(status), new_id))
        .withColumn("error", F.nullif(message, F.lit("")))
        .withColumn("ok", is_ok(status) & ~no_id)
        .withColumn("status", F.when(no_id, F.lit(NO_ID)).otherwise(status))
        .select("run_seq", "feed_id", "uid", "kind", "ok", "status", "event_id", "error")
    )


def longest_retry_after(
    responses: DataFrame, settled: DataFrame, max_attempts: int = MAX_ATTEMPTS
) -> DataFrame:
    """Largest numeric Retry-After over the requests of each batch attempt that are sent again."""
    again = responses.where(is_retryable(F.col("status")) & (F.col("attempt") < max_attempts))
    still_open = F.col("settled_attempt").isNull() | (F.col("settled_attempt") > F.col("attempt"))
    return (
        again.join(settled.select(*REQUEST_KEY, "settled_attempt"), REQUEST_KEY, "left")
        .where(still_open)
        .groupBy("run_seq", "feed_id", "batch_id", "attempt")
        .agg(
            F.count(F.lit(1)).alias("sent_again"),
            F.max(js_number(F.col("retry_after"))).alias("retry_after_s"),
        )
    )


def backoff_ms(attempt: Column, retry_after: Column, now: Column) -> Column:
    """Delay before the next attempt, without the random jitter.

    A numeric Retry-After is seconds, else a date is waited for, else the delay doubles per attempt.
    """
    present = F.nullif(retry_after, F.lit(""))
    seconds = js_number(present)
    http_date = F.try_to_timestamp(
        F.nullif(F.regexp_extract(present, HTTP_DATE, 1), F.lit("")),
        F.lit("dd MMM yyyy HH:mm:ss"),
    )
    until = F.coalesce(http_date, parse_iso(present))
    left = F.unix_millis(until) - F.unix_millis(now)
    wait = F.when(left.isNotNull(), F.greatest(left, F.lit(0)))
    doubled = BASE_BACKOFF_MS * F.pow(F.lit(2.0), attempt - 1)
    chosen = F.when(seconds >= 0, seconds * 1000).otherwise(F.coalesce(wait.cast("double"), doubled))
    return F.least(chosen, F.lit(float(MAX_BACKOFF_MS))).cast("bigint")
