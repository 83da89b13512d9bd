"""Predicates on response statuses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statuses worth another attempt, and those that point at the configuration.
RETRYABLE = (429, 500, 502, 503, 504)
CONFIG_FAULT = (401, 403)
# Fixed values of the backoff: first delay, ceiling, attempts.
BASE_BACKOFF_MS = 500
MAX_BACKOFF_MS = 20_000
MAX_ATTEMPTS = 3
# Fixed value: status of a request that no attempt settled, and of a create that came without an id.
UNSETTLED = 503
NO_ID = 502


def is_ok(status: Column) -> Column:
    return status.between(200, 299)


def is_retryable(status: Column) -> Column:
    """Whether the sink's status is worth another attempt."""
    return status.isin(*RETRYABLE)


def is_feed_retryable(status: Column) -> Column:
    """Whether a feed host's status is worth another attempt."""
    return status.isin(408, 429) | (status >= 500)


def is_config_fault(status: Column) -> Column:
    return status.isin(*CONFIG_FAULT)


def failure_class(kind: Column, status: Column) -> Column:
    """NULL for success; a vanished target of an update or delete is housekeeping, not a failure."""
    return (
        F.when(is_ok(status), F.lit(None).cast("string"))
        .when((status == 404) & (kind != "create"), "housekeeping")
        .when(is_config_fault(status), "configuration")
        .otherwise("failure")
    )
