"""A mixture of sources with target shares of the tokens, by iterative proportional fitting.

The corpus is summed into cells of source, language and topic; their number is bounded by the lists they are taken
from, so the fit runs on the driver over a table of a few thousand rows whatever the corpus. Cell weights are raked in
turn to the sources' target shares and to the corpus's own shares of languages and topics, each cell staying below its
source's cap. The quotient of a cell's weight and its tokens is how often each of its documents is expected to be used.

The total is a parameter; if none is given it is the largest for which no source has to be used more often than allowed.
A source whose cap is below its share of a larger total gives all it may, and the report shows which. Shares of sources
without tokens are spread over the others in proportion. Documents are drawn by systematic sampling: in buckets of
bounded size, in the order of language, topic and size, each is used the whole number below what is expected of it, and
once more wherever the running sum of the remainders, from a random start, passes a whole number. So no document is used
more than the cap, every document is used as often as expected on average, and in each bucket the number of uses in any
run of cells misses what is expected by less than one.

Null or empty texts have no tokens and aren't used. Documents without source, or of a source without weight, have the
share 0. Ties in the order are broken by doc_id. Repeated texts are documents of their own. An empty corpus gives no
rows in the mixture.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import bounded_broadcast, materialize
from . import bpe

#: What a code of a language is; anything else is 'other'. So there are at most 26 ** 2 + 26 ** 3 + 1 languages.
LANGUAGE = r"^[a-z]{2,3}$"
#: Documents in a bucket of the drawing.
BUCKET = 50_000
ROUNDS, TOLERANCE = 500, 1e-9


def topic_of(industry: Column) -> Column:
    """The division of an industry code, '00' where there is none: at most 100 topics."""
    return F.coalesce(F.nullif(F.regexp_extract(industry, r"^(\d{2})", 1), F.lit("")), F.lit("00"))


def rake(cells: pd.DataFrame, shares: dict[str, float], caps: dict[str, int], total: float | None = None) -> pd.DataFrame:
    """cells (source, lang, topic, tokens) with expected: how often each document of the cell is used.

    shares: source to target; caps: source to the most uses of one document. The result's attrs tell total, rounds,
    converged, gap (by how much of the total the worst margin misses its target) and binding, the sources at their caps.
    """
    out = cells.copy()
    tokens = out["tokens"].to_numpy(float)
    source = out["source"].to_numpy()
    cap = np.array([caps.get(s, 0) for s in source], float) * tokens
    room = {s: cap[source == s].sum() for s in shares}
    live = {s: p for s, p in shares.items() if p > 0 and room[s] > 0}
    if not live:
        out = out.assign(expected=0.0)
        out.attrs = {"total": 0.0, "rounds": 0, "converged": True, "gap": 0.0, "binding": []}
        return out
    whole = sum(live.values())
    if total is None:
        total = min(room[s] / (p / whole) for s, p in live.items())
    goal = {s: min(total * p / whole, float(room[s])) for s, p in live.items()}
    binding = sorted(s for s in live if goal[s] >= room[s] * (1 - 1e-9))
    total = sum(goal.values())
    margins = [(source, goal)]
    usable = np.isin(source, list(live))
    for name in ("lang", "topic"):
        values = out[name].to_numpy()
        sums = {v: tokens[usable & (values == v)].sum() for v in np.unique(values[usable])}
        scale = total / sum(sums.values())
        margins.append((values, {v: x * scale for v, x in sums.items()}))
    weight = np.where(usable, np.minimum(tokens, cap), 0.0)

    def fit(values: np.ndarray, targets: dict[str, float]) -> None:
        """Scale each group to its target, as far as the caps leave room, which is then used by the group's other cells."""
        for v, target in targets.items():
            rows = np.flatnonzero(usable & (values == v))
            for _ in range(20):
                now = weight[rows].sum()
                if abs(now - target) <= TOLERANCE * total:
                    break
                if now > target:
                    weight[rows] *= target / now
                    break
                free = rows[weight[rows] < cap[rows] * (1 - 1e-12)]
                held = weight[free].sum()
                if not held:
                    break
                weight[free] = np.minimum(cap[free], weight[free] * (target - now + held) / held)

    rounds, converged = 0, False
    while rounds < ROUNDS and not converged:
        rounds += 1
        before = weight.copy()
        for values, targets in margins[1:]:
            fit(values, targets)
        fit(*margins[0])  # the sources last: their shares hold exactly
        converged = bool(np.abs(before - weight).max() <= TOLERANCE * total)
    gap = max(abs(weight[usable & (values == v)].sum() - x) for values, targets in margins for v, x in targets.items()) / total if total else 0.0
    out = out.assign(expected=np.divide(weight, tokens, out=np.zeros_like(weight), where=tokens > 0))
    out.attrs = {"total": float(total), "rounds": rounds, "converged": converged, "gap": float(gap), "binding": binding}
    return out


def sized(documents: DataFrame, entities: DataFrame, path: str = bpe.VOCABULARY) -> DataFrame:
    """doc_id, source, lang, topic, tokens of every document."""
    rows = entities.where("status = 200").select(F.col("body.organisasjonsnummer").alias("organisation_number"), "snapshot_date", F.col("body.naeringskode1.kode").alias("code"))
    latest = rows.where("organisation_number is not null and code is not null").groupBy("organisation_number").agg(F.max(F.struct("snapshot_date", "code")).alias("m"))
    topics = latest.select("organisation_number", topic_of(F.col("m.code")).alias("topic"))
    lang = F.when(F.lower("lang").rlike(LANGUAGE), F.lower("lang")).otherwise("other")
    counted = bpe.count_tokens(documents.select("doc_id", "source", lang.alias("lang"), "organisation_number", "text"), path=path)
    return counted.join(topics, "organisation_number", "left").select("doc_id", "source", "lang", F.coalesce("topic", F.lit("00")).alias("topic"), "tokens")


class Mixture:
    """The documents used, and the shares they come to."""

    def __init__(self, documents: DataFrame, weights: DataFrame, cells: DataFrame, fit: dict):
        self.documents, self.weights, self.cells, self.fit = documents, weights, cells, fit

    def report(self) -> DataFrame:
        """One row: the fit's total, rounds, whether it converged, its worst margin's gap, and the sources at their caps."""
        f = self.fit
        return self.documents.sparkSession.createDataFrame([(f["total"], f["rounds"], f["converged"], f["gap"], f["binding"])], "total double, rounds int, converged boolean, gap double, binding array<string>")

    def shares(self) -> DataFrame:
        """For each source: target and actual share of the tokens, the cap, documents, uses and tokens."""
        used = self.documents.groupBy("source").agg(
            F.count("*").alias("documents"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"), F.sum(F.col("uses") * F.col("tokens")).alias("tokens")
        )
        every = self.cells.groupBy("source").agg(F.sum("docs").alias("available_documents"), F.sum("tokens").alias("available_tokens"))
        out = self.weights.join(every, "source", "full_outer").join(used, "source", "left")
        counts = ["documents", "uses", "most_uses", "tokens", "available_documents", "available_tokens"]
        out = out.na.fill(0, counts).na.fill(0.0, ["target_share"]).withColumn("max_repeat", F.coalesce("max_repeat", F.lit(0)))
        total = F.sum("tokens").over(W.partitionBy(F.lit(0)))  # a few sources
        return out.withColumn("actual_share", F.when(total > 0, F.col("tokens") / total).otherwise(0.0))

    def margins(self) -> DataFrame:
        """For languages and topics: the tokens of the corpus, those that the fit expects, and those of the mixture."""
        parts = []
        for name in ("lang", "topic"):
            a = self.cells.where("expected > 0").groupBy(F.col(name).alias("value")).agg(F.sum("tokens").alias("corpus_tokens"), F.sum(F.col("expected") * F.col("tokens")).alias("fitted_tokens"))
            b = self.documents.groupBy(F.col(name).alias("value")).agg(F.sum(F.col("uses") * F.col("tokens")).alias("mixture_tokens"))
            parts.append(a.join(b, "value", "left").select(F.lit(name).alias("margin"), "value", "corpus_tokens", "fitted_tokens", F.coalesce("mixture_tokens", F.lit(0)).alias("mixture_tokens")))
        return parts[0].unionByName(parts[1])


def draw(rows: DataFrame, seed: int) -> DataFrame:
    """The documents that are used, with their uses; rows: doc_id, source, lang, topic, tokens, expected, bucket."""
    chance = lambda *cols: F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)) / F.lit(float(1 << 52))
    order = W.partitionBy("source", "bucket").orderBy("lang", "topic", F.desc("tokens"), F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
    whole = F.floor(F.col("expected") + 1e-9)
    rest = F.greatest(F.col("expected") - whole, F.lit(0.0))
    upto = F.sum("_rest").over(order.rowsBetween(W.unboundedPreceding, 0)) + chance("source", "bucket")
    run = rows.withColumn("_whole", whole).withColumn("_rest", rest).withColumn("_upto", upto)
    uses = F.col("_whole") + F.floor(F.col("_upto") + 1e-9) - F.floor(F.col("_upto") - F.col("_rest") + 1e-9)
    return run.withColumn("uses", uses.cast("int")).where("uses > 0").select("doc_id", "source", "lang", "topic", "tokens", "uses")


def mix(docs: DataFrame, weights: DataFrame, seed: int = 0, total: float | None = None) -> Mixture:
    """The mixture of docs (doc_id, source, lang, topic, tokens) by weights (source, target_share, max_repeat)."""
    spark: SparkSession = docs.sparkSession
    docs = materialize(docs, "sized")
    targets = weights.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeat").alias("max_repeat"))
    listed = targets.collect()  # one row for each source in the table of weights
    known = [r["source"] for r in listed]
    group = F.when(F.col("source").isin(known), F.col("source"))
    cells = docs.withColumn("source", group).groupBy("source", "lang", "topic").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")).toPandas()
    cells["source"] = cells["source"].where(cells["source"].notna(), None)
    fitted = rake(cells, {r["source"]: r["target_share"] or 0.0 for r in listed}, {r["source"]: r["max_repeat"] or 0 for r in listed}, total)
    schema = "source string, lang string, topic string, docs long, tokens long, expected double"
    table = spark.createDataFrame([(a, b, c, int(n), int(t), float(e)) for a, b, c, n, t, e in fitted[["source", "lang", "topic", "docs", "tokens", "expected"]].itertuples(index=False, name=None)], schema)
    buckets = max(1, int(fitted["docs"].sum()) // BUCKET)
    rows = docs.where("tokens > 0").join(bounded_broadcast(table.where("expected > 0").select("source", "lang", "topic", "expected")), ["source", "lang", "topic"])
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(buckets).cast("long")))
    return Mixture(draw(rows, seed), targets, table, fitted.attrs)
