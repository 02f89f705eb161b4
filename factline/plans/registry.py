"""All queries of the core by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import builder_queries, claims_queries, marks_queries, matching_queries, problems, problems_sql, text_queries, wide_queries

CATALOGS = (matching_queries.catalog, claims_queries.catalog, text_queries.catalog, builder_queries.catalog, marks_queries.catalog, wide_queries.catalog)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = dict(problems.QUERIES)
    for c in CATALOGS:
        found |= c.queries
    return found


def oracle_sql() -> dict[str, str]:
    found = dict(problems_sql.SQL)
    for c in CATALOGS:
        found |= c.sql
    return found
