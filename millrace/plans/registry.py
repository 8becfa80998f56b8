"""All queries of the package, by name, and the SQL that states the same result."""

from __future__ import annotations

from . import row_queries, state_queries

_ALL = row_queries.QUERIES | state_queries.QUERIES
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql is not None}
