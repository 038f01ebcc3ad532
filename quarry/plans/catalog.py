"""Every query of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from quarry.plans import graph_queries, record_queries, text_queries

QUERIES = {**text_queries.QUERIES, **graph_queries.QUERIES, **record_queries.QUERIES}
ORACLE_SQL = {**text_queries.ORACLE_SQL, **graph_queries.ORACLE_SQL, **record_queries.ORACLE_SQL}
FLAGSHIP = "graph_context"
