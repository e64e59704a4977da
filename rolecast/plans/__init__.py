"""Registered queries and their SQL, by name."""

from . import match_queries, record_queries, store_queries, text_queries

QUERIES = {**text_queries.QUERIES, **match_queries.QUERIES, **store_queries.QUERIES, **record_queries.QUERIES}
ORACLES = {**text_queries.ORACLES, **match_queries.ORACLES, **store_queries.ORACLES, **record_queries.ORACLES}
