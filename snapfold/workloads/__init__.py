"""Named queries over the given tables, each with the SQL that gives the same rows."""

from snapfold.workloads import decoding, payloads, reconciling, records  # noqa: F401
from snapfold.workloads.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
