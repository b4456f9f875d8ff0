"""All queries of the engine's own operators."""

from __future__ import annotations

from . import collection_queries, document_queries, hash_string_queries, live_queries, more_queries  # noqa: F401  (they register)
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
