"""Every registered query with its oracle, gathered from the query modules."""

from . import relational_queries, spatial_queries, text_queries

MODULES = (relational_queries, text_queries, spatial_queries)
QUERIES: dict = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
