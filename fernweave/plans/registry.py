"""All queries of the core, by name."""

from __future__ import annotations

from fernweave.plans import analysis_queries, core_queries, entity_queries, extension_queries, feedback_queries, report_queries

FLAGSHIP = "win_3_topic_changes"
_CATALOGS = (feedback_queries.query, analysis_queries.query, entity_queries.query, extension_queries.query, report_queries.query)


def queries() -> dict:
    return core_queries.QUERIES | {name: f for c in _CATALOGS for name, f in c.queries.items()}


def oracle_sql() -> dict:
    return core_queries.ORACLE_SQL | {name: sql for c in _CATALOGS for name, sql in c.sql.items()}
