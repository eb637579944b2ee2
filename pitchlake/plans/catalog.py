"""All registered queries of the engine and their DuckDB SQL."""

from __future__ import annotations

from pitchlake.plans import data_queries, match_queries, record_queries, state_queries

QUERIES = {**match_queries.QUERIES, **data_queries.QUERIES, **record_queries.QUERIES, **state_queries.QUERIES}
ORACLE_SQL = {**match_queries.ORACLE_SQL, **data_queries.ORACLE_SQL, **record_queries.ORACLE_SQL, **state_queries.ORACLE_SQL}
