"""The analyses bound to the driver tables, each with its SQL where SQL can express it."""

from turnmill.queries import accounts, checks, corpus, evidence, generations, logs, receipts, records, stored, usage  # noqa: F401
from turnmill.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
