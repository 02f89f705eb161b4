"""Joins that are written by hand elsewhere: key filters, OR conditions, several keys, token overlap, hierarchies.

Null keys match nothing. Extra columns of the right side must not clash with the left's unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import materialize
from .skew import hot_join


def wanted(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is listed."""
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def either_key(rows: DataFrame, columns: Sequence[str], keys: DataFrame, key: str, row_id: Sequence[str]) -> DataFrame:
    """key and the rows that have it in any of the columns; an equi join for each column instead of an OR.

    A row that matches a key by several columns is given once for it.
    """
    parts = [rows.join(keys.select(F.col(key).alias("_key")).distinct(), F.col(c) == F.col("_key")).withColumnRenamed("_key", key) for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates([key, *row_id])


def several_keys(left: DataFrame, right: DataFrame, left_id: str, right_id: str, keys: dict[str, tuple[str, str]]) -> DataFrame:
    """left_id, right_id, how (sorted names of the keys that agree) and matches (their number).

    keys: name to (column of left, column of right); each is an equi join of its own, '' is no value.
    """
    sides = []
    for name, (a, b) in keys.items():
        x = left.where(F.col(a) != "").select(left_id, F.col(a).alias("_v")).distinct()
        y = right.where(F.col(b) != "").select(right_id, F.col(b).alias("_v")).distinct()
        sides.append(hot_join(x, y, "_v").select(left_id, right_id, F.lit(name).alias("_how")))
    out = sides[0]
    for s in sides[1:]:
        out = out.unionByName(s)
    return out.groupBy(left_id, right_id).agg(F.array_sort(F.collect_set("_how")).alias("how"), F.count_distinct("_how").alias("matches"))


def token_overlap(left: DataFrame, right: DataFrame, least: float = 0.6) -> DataFrame:
    """a, b and overlap of the pairs whose common words are at least that part of the smaller set.

    left: a, tokens; right: b, tokens (arrays of distinct words). A pair that qualifies shares a word among the rarest
    n - ceil(least * n) + 1 of its smaller set, so only those are joined, against all words of the sets that are at
    least as large, from either side; frequent words hardly take part. Empty sets match nothing.
    """
    a = left.where(F.size("tokens") > 0).select("a", F.col("tokens").alias("ta"))
    b = right.where(F.size("tokens") > 0).select("b", F.col("tokens").alias("tb"))
    one = a.select(F.col("a").alias("id"), F.lit("a").alias("side"), F.col("ta").alias("t")).unionByName(b.select(F.col("b").alias("id"), F.lit("b").alias("side"), F.col("tb").alias("t")))
    spread = materialize(one.select("id", "side", F.size("t").alias("n"), F.explode("t").alias("w")), "words")
    often = spread.groupBy("w").agg(F.count("*").alias("df"))
    ranked = hot_join(spread, often, "w").withColumn("r", F.row_number().over(W.partitionBy("side", "id").orderBy("df", "w")))
    ranked = materialize(ranked, "ranked-words")
    rare = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    xa, xb = ranked.where("side = 'a'"), ranked.where("side = 'b'")
    ra, rb = rare.where("side = 'a'"), rare.where("side = 'b'")

    def meet(x: DataFrame, y: DataFrame, small_first: bool) -> DataFrame:
        p = x.select("w", F.col("id").alias("a"), F.col("n").alias("na"))
        q = y.select("w", F.col("id").alias("b"), F.col("n").alias("nb"))
        fits = F.col("na") <= F.col("nb") if small_first else F.col("nb") <= F.col("na")
        return hot_join(p, q, "w").where(fits).select("a", "b")

    pairs = meet(ra, xb, True).unionByName(meet(xa, rb, False)).distinct()
    common = F.size(F.array_intersect("ta", "tb")) / F.least(F.size("ta"), F.size("tb"))
    return pairs.join(a, "a").join(b, "b").withColumn("overlap", common).where(F.col("overlap") >= least).select("a", "b", "overlap")


def cascade(matches: DataFrame, keys: Sequence[str], rank: str) -> DataFrame:
    """For each combination of keys the match of the lowest rank."""
    w = W.partitionBy(*keys).orderBy(rank)
    return matches.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def ancestors(edges: DataFrame) -> DataFrame:
    """child, ancestor and distance over edges (child, parent), to any depth; distance is the least.

    Paths double in length from round to round, so depth d takes about log2(d) rounds, each an equi join of written
    tables, with salts for ancestors that very many have. Null children or parents are no edges, nor are edges of a child
    to itself. A cycle raises ValueError.
    """
    edges = edges.where("child is not null and parent is not null and child <> parent").select("child", "parent").distinct()
    paths = materialize(edges.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")), "edges")
    reach = 1
    while True:
        longest = paths.where(F.col("distance") > reach // 2) if reach > 1 else paths
        step = paths.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("_up"), F.col("distance").alias("_more"))
        longer = hot_join(longest, step, "ancestor").select("child", F.col("_up").alias("ancestor"), (F.col("distance") + F.col("_more")).alias("distance"))
        every = paths.unionByName(longer).groupBy("child", "ancestor").agg(F.min("distance").alias("distance"))
        every = materialize(every, "paths")
        if not every.where("child = ancestor").isEmpty():
            raise ValueError("the hierarchy has a cycle")
        if every.count() == paths.count():
            return every
        paths, reach = every, 2 * reach
