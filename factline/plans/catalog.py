"""A list of queries, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

#: The latest snapshot of the claims, in SQL.
SQL_NEWEST = "(SELECT max(snapshot_no) FROM claims)"


def newest(claims: DataFrame) -> DataFrame:
    """The claims of the latest snapshot."""
    return claims.where(F.col("snapshot_no") == claims.agg(F.max("snapshot_no")).scalar())


Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Callable], Callable]:
        """Register a function of a reader of tables under its name; the reader takes a table's name."""

        def add(f: Callable) -> Callable:
            def run(spark: SparkSession, d: str) -> DataFrame:
                return f(lambda name: table(spark, d, name))

            run.__doc__ = f.__doc__
            self.queries[f.__name__] = run
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add
