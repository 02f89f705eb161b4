"""Aggregates over groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import bounded_broadcast, materialize


#: Parts of a range of values in the search for a rank, and distinct values that one task may put in order at its end.
BINS = 1024
ORDERED = 100_000


def nearest_ranks(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """keys, share and the number at the half-even rounded rank share * (n - 1) of a group's ordered values.

    Equal values are counted together first. A histogram of BINS parts of a range tells the part that holds a rank;
    while that part has more than ORDERED distinct values its own range, from its least value to its greatest, is divided
    in the same way. So however values are spread (one far off may put all others in one part) no task orders more than
    that, and each round divides the range by BINS. Only the last parts' values are ordered. Nulls and null keys don't count.
    """
    counts = materialize(rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n")), "counts")
    ranges = counts.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum("_n").alias("_all"))
    wanted = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), (F.bround(F.lit(float(s)) * (F.col("_all") - 1), 0) + 1).alias("rank")) for s in shares]))
    state = ranges.withColumn("_w", wanted).select(*keys, F.col("_w.share").alias("share"), F.col("_w.rank").alias("_rank"), "_lo", "_hi")
    while True:
        within = counts.join(bounded_broadcast(state), list(keys)).where(F.col(value).between(F.col("_lo"), F.col("_hi")))
        part = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (BINS - 1))).otherwise(F.lit(0).cast("long"))
        parts = within.withColumn("_part", part).groupBy(*keys, "share", "_part").agg(
            F.sum("_n").alias("_n"), F.count("*").alias("_distinct"), F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.first("_rank").alias("_rank")
        )
        parts = parts.withColumn("_to", F.sum("_n").over(W.partitionBy(*keys, "share").orderBy("_part").rowsBetween(W.unboundedPreceding, 0)))
        hit = parts.where((F.col("_rank") <= F.col("_to")) & (F.col("_rank") > F.col("_to") - F.col("_n")))
        hit = materialize(hit.select(*keys, "share", (F.col("_rank") - F.col("_to") + F.col("_n")).alias("_rank"), "_lo", "_hi", "_distinct"), "parts")
        state = hit.drop("_distinct")
        if (hit.agg(F.max("_distinct")).first()[0] or 0) <= ORDERED:
            break
    inner = counts.join(bounded_broadcast(state), list(keys)).where(F.col(value).between(F.col("_lo"), F.col("_hi")))
    upto = F.sum("_n").over(W.partitionBy(*keys, "share").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    found = inner.withColumn("_upto", upto).where((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n")))
    return found.select(*keys, "share", value)


def counts_of(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """A table of value and a count for each named column, outer-merged with 0 for what is missing.

    One pass: the columns are unpivoted and counted by condition.
    """
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(c).alias("v")) for n, c in names.items()])).alias("x")).select("x.n", "x.v")
    return long.where("v is not null").groupBy(F.col("v").alias("value")).agg(*[F.count_if(F.col("n") == n).alias(n) for n in names])
