"""All registered queries and their DuckDB counterparts."""

from __future__ import annotations

from flowseries.plans import binary_queries, point_queries, store_queries

_ALL = (point_queries.REGISTERED, binary_queries.REGISTERED, store_queries.REGISTERED)
QUERIES = {k: f for r in _ALL for k, (f, _) in r.items()}
ORACLE_SQL = {k: sql for r in _ALL for k, (_, sql) in r.items() if sql}
