"""Which row of several: first and last wins, latest by key, top k, sampling by hash.

Every choice has an order that ends in a column with unique values, so results don't depend on the partitioning.
Latest-by-key choices are aggregates with map-side combination; a hot key sends one row from each task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _best(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], largest: bool) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    pick = F.max if largest else F.min
    packed = pick(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c) for c in rest])).alias("_b")
    return rows.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def last_wins(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The row with the greatest order of each key; ties go to the greatest other columns."""
    return _best(rows, keys, order, True)


def first_wins(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The row with the least order of each key; ties go to the least other columns."""
    return _best(rows, keys, order, False)


def compact(log: DataFrame, key: str, order: Sequence[Column], status: str, live: str) -> DataFrame:
    """The present state of an event log: each key's last event, without keys whose last status isn't live."""
    return last_wins(log, [key], *order).where(F.col(status) == live)


def top(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: Column | int, most: int | None = None) -> DataFrame:
    """At most limit rows of each key, with their rank.

    limit may be a column; most is then the largest that it can be. By that literal Spark cuts each key's rows in
    every task before they are shuffled, so a hot key sends only most rows from each.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    ranked = rows.withColumn("rank", F.row_number().over(w))
    if not isinstance(limit, Column):
        return ranked.where(F.col("rank") <= limit)
    return (ranked.where(F.col("rank") <= most) if most is not None else ranked).where(F.col("rank") <= limit)


def hash_rank(key: Column, seed: int | str, salt: str = "") -> Column:
    """A random order that is the same in every run: SHA-256 of seed, salt and key."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), key), 256)


def splits(rows: DataFrame, key: str, seed: int | str, sizes: dict[str, int], salt: str = "core") -> DataFrame:
    """Disjoint random samples of the sizes named, in the column split.

    The bounded head of the hash order is taken with a limit, which needs no sort of all rows; only it is numbered.
    """
    total = sum(sizes.values())
    head = rows.withColumn("_h", hash_rank(F.col(key), seed, salt)).orderBy("_h", key).limit(total)
    numbered = head.withColumn("_n", F.row_number().over(W.orderBy("_h", key)))
    name, start = F.lit(None).cast("string"), 0
    for split, size in sizes.items():
        name = F.when((F.col("_n") > start) & (F.col("_n") <= start + size), split).otherwise(name)
        start += size
    return numbered.withColumn("split", name).drop("_h", "_n")


def round_robin(rows: DataFrame, bucket: str, key: str, seed: int | str, total: int, salt: str = "stress") -> DataFrame:
    """total rows, one from each bucket in turn in the order of the buckets' names, each in its hash order."""
    h = hash_rank(F.col(key), seed, salt)
    return top(rows, [bucket], [h, F.col(key)], total).orderBy("rank", bucket).limit(total).drop("rank")


def priority_dedup(rows: DataFrame, keys: Sequence[str], item: str, priority: str, seen: str) -> DataFrame:
    """One row for each item of the keys: the lowest priority, then the first seen; position is where it was first seen."""
    rest = [c for c in rows.columns if c not in (*keys, item)]
    best = F.min(F.struct(F.col(priority).alias("_p"), F.col(seen).alias("_s"), F.struct(*rest).alias("_r"))).alias("_b")
    return rows.groupBy(*keys, item).agg(best, F.min(seen).alias("position")).select(*keys, item, *[F.col(f"_b._r.{c}").alias(c) for c in rest], "position")


def first_success(rows: DataFrame, keys: Sequence[str], order: str, verdict: str, unconfirmed: str) -> DataFrame:
    """For each key the first row that is exact, else the first related; after an unconfirmed row only strict ones count.

    rows also have strict, whether the row meets the higher bar; order is unique in a key. Of rows that aren't strict
    only the first of a verdict matters, and it counts unless an unconfirmed row came before, so one aggregation tells.
    """
    rest = [c for c in rows.columns if c not in (*keys, order)]
    packed = F.struct(order, *rest)
    firsts = {f"_{v}_{s}": F.min(F.when((F.col(verdict) == v) & (F.coalesce("strict", F.lit(False)) == s), packed)) for v in ("exact", "related") for s in (True, False)}
    sums = rows.groupBy(*keys).agg(F.min(F.when(F.col(unconfirmed), F.col(order))).alias("_bar"), *[a.alias(n) for n, a in firsts.items()])

    def best(v: str) -> Column:
        loose = F.col(f"_{v}_False")
        return F.least(F.col(f"_{v}_True"), F.when(F.col("_bar").isNull() | (loose[order] <= F.col("_bar")), loose))

    hit = sums.select(*keys, F.coalesce(best("exact"), best("related")).alias("_b")).where("_b is not null")
    return hit.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in (order, *rest)])
