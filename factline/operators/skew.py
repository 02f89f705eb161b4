"""Joins on keys of which one may hold a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import BROADCAST_ROWS

#: A key is hot with more rows than this, and is spread over as many parts as it has so many rows.
HOT_ROWS = 100_000

#: A hot key and the number of its parts.
Hot = tuple[Any, int]


def hot_keys(rows: DataFrame, key: str, least: int | None = None) -> list[Hot]:
    """The keys with more than least rows, each with the number of its parts; counts are combined on the map side.

    Of N rows at most BROADCAST_ROWS keys can have more than N / BROADCAST_ROWS each. Where more keys than that have
    more than least rows, that quotient takes its place: the list is never longer, and any key that isn't on it has no
    more rows than one of so many tasks gets anyway. rows are scanned once or twice, so they should be a written table.
    """
    least = HOT_ROWS if least is None else least
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).count()
    found = counts.where(F.col("count") > least).limit(BROADCAST_ROWS + 1).collect()
    if len(found) > BROADCAST_ROWS:
        least = -(-rows.count() // BROADCAST_ROWS)
        found = counts.where(F.col("count") > least).collect()
    return sorted(((r[key], -(-r["count"] // least)) for r in found), key=str)


def hot_join(many: DataFrame, few: DataFrame, key: str, hot: Sequence[Hot] | None = None, how: str = "inner") -> DataFrame:
    """Join (inner or left) in which the rows of many with a hot key are spread over the key's parts.

    The rows of few with a hot key are repeated for each part; all others meet as in any join. hot are the keys of
    hot_keys(many, key), which is asked where none are given. The part of a row follows from its hash, so it is the same
    when a lost task is run again. Null keys match nothing.
    """
    if hot is None:
        hot = hot_keys(many, key)
    if not hot:
        return many.join(few, key, how)
    spark = many.sparkSession
    kind = many.schema[key].dataType.simpleString()
    parts = F.broadcast(spark.createDataFrame(list(hot), f"`{key}` {kind}, _parts int"))  # at most BROADCAST_ROWS rows
    others = [c for c in many.columns if c != key]
    left = many.join(parts, key, "left").withColumn("_part", F.pmod(F.xxhash64(*others) if others else F.lit(0), F.coalesce("_parts", F.lit(1)).cast("long"))).drop("_parts")
    right = few.join(parts, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)).cast("long") - 1))).drop("_parts")
    return left.join(right, [key, "_part"], how).drop("_part")
