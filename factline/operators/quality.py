"""Reports, health, invariants and scores over claims, states and labels, as conditional aggregates in one pass each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import share

# Families of facts, those outside the register, and thresholds of a run's health.
FAMILIES = ("identity", "financials", "financial_history", "leadership", "locations", "website", "profiles", "description", "activity", "jobs", "group", "reviews")
EXTERNAL = ("website", "profiles", "activity", "jobs")
IDENTITY_FAILED_SHARE = 0.02
CONNECTION_FAILURE_SHARE = 0.15


def zero_filled(rows: DataFrame, by: str, values: Sequence[str], kind: str, kinds: Sequence[str]) -> DataFrame:
    """A row for each listed value, with a count for each listed kind, 0 where there are none."""
    counts = rows.groupBy(by).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds])
    every = rows.sparkSession.createDataFrame([(v,) for v in values], f"{by} string")
    return every.join(counts, by, "left").na.fill(0, list(kinds))


def violations(rows: DataFrame, key: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """key and rule of every broken rule: a rule is a condition that holds where it is broken; null is not broken."""
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return rows.select(*key, F.explode(found).alias("rule"))


def health(rows: DataFrame, companies: Column, identity_failed: Column, requests: Column, connection_failures: Column) -> DataFrame:
    """One row: shares of failures and the reasons for which a run counts as degraded; thresholds are strict."""
    sums = rows.agg(companies.alias("companies"), identity_failed.alias("identity_failed"), requests.alias("requests"), connection_failures.alias("connection_failures"))
    a = F.col("identity_failed") / F.greatest("companies", F.lit(1)) > IDENTITY_FAILED_SHARE
    b = F.col("connection_failures") / F.greatest("requests", F.lit(1)) > CONNECTION_FAILURE_SHARE
    out = sums.withColumn("connection_failure_share", F.bround(F.col("connection_failures") / F.greatest("requests", F.lit(1)), 3))
    reasons = F.array(
        F.when(a, F.concat(F.lit("registry lookup failed for "), F.col("identity_failed").cast("string"), F.lit(" of "), F.col("companies").cast("string"), F.lit(" companies"))),
        F.when(b, F.concat(F.col("connection_failures").cast("string"), F.lit(" of "), F.col("requests").cast("string"), F.lit(" requests failed at the connection level"))),
    )
    return out.withColumn("degraded", a | b).withColumn("reasons", F.array_join(F.filter(reasons, lambda x: x.isNotNull()), "; "))


def precision_recall(rows: DataFrame, by: Sequence[str], published: Column, truth: Column, correct: Column) -> DataFrame:
    """Counts with precision and recall to four digits, null where nothing was published or nothing is true."""
    sums = rows.groupBy(*by).agg(F.count_if(published).alias("published"), F.count_if(truth).alias("truth"), F.count_if(published & truth & correct).alias("correct"))
    return sums.withColumns({n: F.when(F.col(d) > 0, share(F.col("correct"), F.col(d))) for n, d in (("precision", "published"), ("recall", "truth"))})


def micro_sets(rows: DataFrame, expected: str, produced: str) -> DataFrame:
    """One row: precision and recall over the elements of two array columns, taken as sets."""
    hit = F.size(F.array_intersect(expected, produced))
    sums = rows.agg(F.sum(hit).alias("hits"), F.sum(F.size(F.array_distinct(expected))).alias("expected"), F.sum(F.size(F.array_distinct(produced))).alias("produced"))
    return sums.withColumns({"precision": share(F.col("hits"), F.col("produced")), "recall": share(F.col("hits"), F.col("expected"))})


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate over rows whose value isn't null; null without weight."""
    total = F.sum(F.when(value.isNotNull(), weight))
    return F.when(total > 0, F.sum(weight * value) / total)


def decide(baseline: str, challenger: str, margin: float = 0.0) -> Column:
    """REJECT below the baseline, PROMOTE above it by the margin, else HOLD."""
    return F.when(F.col(challenger) < F.col(baseline), "REJECT").when(F.col(challenger) > F.col(baseline) + margin, "PROMOTE").otherwise("HOLD")
