"""Ordered decision lists over collected signals, and states derived from outcomes of requests.

The rules are the caller's: a ladder is a list of (name, condition), of which the first that holds decides. What is
decided here is only how signals meet and in which order rules apply.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gathered(signals: DataFrame, keys: Sequence[str], kind: str = "kind") -> DataFrame:
    """keys with the sorted set of their kinds of signals and the number of different ones."""
    return signals.groupBy(*keys).agg(F.array_sort(F.collect_set(kind)).alias("kinds"), F.count_distinct(kind).alias("different"))


def has(kind: str) -> Column:
    """Whether the kinds gathered include one."""
    return F.array_contains("kinds", kind)


def ladder(rules: Sequence[tuple[str, Column]], other: str) -> Column:
    """The name of the first rule that holds; a null condition doesn't."""
    out = F.lit(other)
    for name, rule in reversed(rules):
        out = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(out)
    return out


def strongest(signals: DataFrame, keys: Sequence[str], kind: str, rank: str, limit: int = 5) -> DataFrame:
    """At most limit signals of each key, one of each kind, strongest first."""
    from .choosing import first_wins, top

    once = first_wins(signals, [*keys, kind], F.col(rank))
    return top(once, keys, [F.col(rank), F.col(kind)], limit)


def availability(status: Column, error: Column, empty: Column) -> Column:
    """A source's state: available, not_available (404, 410 or an empty answer), blocked (401, 403, 429) or failed."""
    return F.when(status.isin(404, 410), "not_available").when(status.isin(401, 403, 429), "blocked").when(error.isNotNull() | status.isNull() | (status >= 400), "failed").when(empty, "not_available").otherwise("available")


def filled(states: DataFrame, orgs: DataFrame, families: Sequence[str], reason: str = "not checked") -> DataFrame:
    """A state for every organisation and family: missing ones are failed with the reason. families is a short list."""
    every = orgs.select("org").distinct().select("org", F.explode(F.array(*[F.lit(f) for f in families])).alias("family"))
    out = every.join(states.select("org", "family", "availability", "reason"), ["org", "family"], "left")
    return out.select("org", "family", F.coalesce("availability", F.lit("failed")).alias("availability"), F.when(F.col("availability").isNull(), reason).otherwise(F.col("reason")).alias("reason"))


def terminal(states: DataFrame) -> DataFrame:
    """org and status: completed without failed families, failed if all failed, else partial."""
    bad = F.col("availability") == "failed"
    sums = states.groupBy("org").agg(F.count_if(bad).alias("failed"), F.count("*").alias("families"))
    return sums.withColumn("status", F.when(F.col("failed") == 0, "completed").when(F.col("failed") == F.col("families"), "failed").otherwise("partial"))
