"""A directory over wide rows: search, facets, comparison, and screens by structured conditions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold


class UnsupportedScreen(ValueError):
    """A field or operator that the directory doesn't have: a screen abstains rather than give an empty result."""


OPERATORS = {
    "eq": lambda c, v: c == F.lit(v),
    ">": lambda c, v: c > F.lit(v),
    ">=": lambda c, v: c >= F.lit(v),
    "<": lambda c, v: c < F.lit(v),
    "<=": lambda c, v: c <= F.lit(v),
    "contains": lambda c, v: F.lower(c).contains(str(v).lower()),
    "present": lambda c, _: c.isNotNull() & (c.cast("string") != ""),
}


def screen(rows: DataFrame, filters: Sequence[tuple[str, str, Any]], sort: tuple[str, str] | None = None, limit: int | None = None, key: str = "org") -> DataFrame:
    """Rows that meet all conditions (field, operator, value), sorted with nulls last and cut; null meets none.

    Raises UnsupportedScreen for an unknown field, operator or sort.
    """
    for field, op, value in filters:
        if field not in rows.columns:
            raise UnsupportedScreen(f"no field {field!r}")
        if op not in OPERATORS:
            raise UnsupportedScreen(f"no operator {op!r}")
        rows = rows.where(OPERATORS[op](F.col(field), value))
    if sort:
        if sort[0] not in rows.columns or sort[1] not in ("asc", "desc"):
            raise UnsupportedScreen(f"no order {sort!r}")
        c = F.col(sort[0])
        rows = rows.orderBy(c.desc_nulls_last() if sort[1] == "desc" else c.asc_nulls_last(), key)
    return rows.limit(limit) if limit is not None else rows


def search(rows: DataFrame, term: str, columns: Sequence[str]) -> DataFrame:
    """Rows whose columns together contain the term in lower case; '' finds all."""
    return rows.where(F.lower(F.concat_ws(" ", *columns)).contains(term.strip().lower())) if term.strip() else rows


def lookup(rows: DataFrame, term: str, name: str, org: str, coverage: str, limit: int = 20) -> DataFrame:
    """By the beginning of the number for three digits or more, else by part of the folded name; names that begin so first."""
    number = "".join(c for c in term if c.isdigit())
    if len(number) >= 3:
        hit, first = F.col(org).startswith(number), F.lit(0)
    else:
        folded, wanted = fold(F.col(name)), fold(F.lit(term))
        hit, first = folded.contains(wanted), F.when(folded.startswith(wanted), 0).otherwise(1)
    return rows.where(hit).orderBy(first, F.desc(coverage), org).limit(limit)


def facets(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """facet, value and count of each column's values, in one pass."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    return long.where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("count"))


def compare(rows: DataFrame, key: str, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """field and one column for each of two to four keys: the chosen rows, turned around."""
    if not 2 <= len(keys) <= 4:
        raise ValueError("two to four keys")
    picked = rows.where(F.col(key).isin(*keys)).select(key, *[F.col(f).cast("string").alias(f) for f in fields])
    return picked.unpivot([key], list(fields), "field", "value").groupBy("field").pivot(key, list(keys)).agg(F.first("value"))


def unpivot(rows: DataFrame, keys: Sequence[str], fields: dict[str, Column]) -> DataFrame:
    """keys, field and value of every field that isn't null: the long form of claims."""
    parts = F.array(*[F.struct(F.lit(n).alias("field"), c.cast("string").alias("value")) for n, c in fields.items()])
    return rows.select(*keys, F.explode(parts).alias("x")).select(*keys, "x.field", "x.value").where("value is not null")
