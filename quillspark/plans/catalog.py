"""All queries over this engine's operators, with their SQL forms."""

from __future__ import annotations

from quillspark.plans import counter_queries, file_queries, library_queries, state_queries

QUERIES = counter_queries.QUERIES | state_queries.QUERIES | library_queries.QUERIES | file_queries.QUERIES
ORACLE_SQL = counter_queries.ORACLE_SQL | state_queries.ORACLE_SQL | library_queries.ORACLE_SQL | file_queries.ORACLE_SQL
