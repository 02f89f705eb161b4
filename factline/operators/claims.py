"""Builders of claims and evidence: nested register bodies and feeds to the long form.

A claim is org, family, field, value_key, value (JSON), period_end, status, and claim_id; evidence is evidence_id,
source_url and span. Null values make no claim. Repeats of a claim are left to operators.choosing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys

# Metrics of accounts and where they stand in a body.
METRICS = {
    "revenue": "resultatregnskapResultat.driftsresultat.driftsinntekter.sumDriftsinntekter",
    "operating_result": "resultatregnskapResultat.driftsresultat.driftsresultat",
    "annual_result": "resultatregnskapResultat.aarsresultat",
    "total_assets": "eiendeler.sumEiendeler",
    "equity": "egenkapitalGjeld.egenkapital.sumEgenkapital",
    "debt": "egenkapitalGjeld.gjeldOversikt.sumGjeld",
}
CLAIM = ["org", "family", "field", "value_key", "value", "period_end", "status"]


def finish(rows: DataFrame) -> DataFrame:
    """rows of CLAIM with their claim_id; those without value drop out."""
    return rows.where("value is not null").select(*CLAIM, keys.claim_id(*[F.col(c) for c in CLAIM[:4]]).alias("claim_id"))


def roles(bodies: DataFrame) -> DataFrame:
    """bodies (org, body of the role register): a claim for each role, by code and name; resigned ones are withdrawn."""
    groups = bodies.select("org", F.explode("body.rollegrupper").alias("g"))
    rows = groups.select("org", F.col("g.sistEndret").alias("changed"), F.explode("g.roller").alias("r")).where("r is not null")
    n = F.col("r.person.navn")
    person = F.nullif(F.concat_ws(" ", n["fornavn"], n["mellomnavn"], n["etternavn"]), F.lit(""))
    name = F.coalesce(person, F.array_join("r.enhet.navn", " "))
    code = F.col("r.type.kode")
    value = F.to_json(F.struct(code.alias("role_code"), F.col("r.type.beskrivelse").alias("role_label"), name.alias("name"), F.col("r.enhet.organisasjonsnummer").alias("entity_organisation_number")))
    status = F.when(F.col("r.avregistrert"), "withdrawn").otherwise("current")
    return finish(
        rows.where(name.isNotNull() & code.isNotNull()).select("org", F.lit("leadership").alias("family"), F.lit("role").alias("field"), F.concat_ws("|", code, name).alias("value_key"), value.alias("value"), F.lit(None).cast("string").alias("period_end"), status.alias("status"))
    )


def latest_role_change(bodies: DataFrame) -> DataFrame:
    """org, the latest change over its role groups, and the groups that changed on that day."""
    g = bodies.select("org", F.explode("body.rollegrupper").alias("g")).where("g.sistEndret is not null").select("org", F.col("g.sistEndret").alias("changed"), F.col("g.type.kode").alias("code"))
    best = g.groupBy("org").agg(F.max("changed").alias("changed"))
    return g.join(best, ["org", "changed"]).groupBy("org", "changed").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("groups"))


def financials(accounts: DataFrame) -> DataFrame:
    """accounts (org, x of the account register): a claim for each metric of the newest accounts of a company, as
    financials, and of each earlier year, as financial_history; consolidated ones with group_ before the metric."""
    from .choosing import last_wins
    from pyspark.sql import Window as W

    rows = accounts.select("org", F.col("x.regnskapstype").alias("kind"), F.col("x.regnskapsperiode.tilDato").alias("period_end"), F.col("x.id").alias("id"), F.col("x.valuta").alias("currency"), *[F.col(f"x.{p}").alias(m) for m, p in METRICS.items()])
    rows = rows.where("period_end is not null and kind in ('SELSKAP', 'KONSERN')").withColumn("year", F.substring("period_end", 1, 4))
    once = last_wins(rows, ["org", "kind", "year"], F.col("period_end"), F.col("id"))
    latest = F.row_number().over(W.partitionBy("org", "kind").orderBy(F.desc("year"))) == 1
    long = once.withColumn("family", F.when(latest, "financials").otherwise("financial_history"))
    parts = F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).alias("amount")) for m in METRICS])
    long = long.select("org", "family", "kind", "period_end", "currency", F.explode(parts).alias("p")).where("p.amount is not null")
    field = F.concat(F.when(F.col("kind") == "KONSERN", "group_").otherwise(""), F.col("p.m"))
    value = F.to_json(F.struct(F.col("p.amount").cast("decimal(24,2)").alias("amount"), "currency"))
    return finish(long.select("org", "family", field.alias("field"), F.when(F.col("family") == "financial_history", F.concat_ws("|", field, F.substring("period_end", 1, 4))).otherwise(field).alias("value_key"), value.alias("value"), "period_end", F.lit("current").alias("status")))


def postings(entries: DataFrame) -> DataFrame:
    """entries (uuid, ad_content JSON): a claim for each ad with an employer's number, by its uuid."""
    at = lambda p: F.coalesce(F.get_json_object("ad_content", f"$.{p}"), F.get_json_object("ad_content", f"$.ad_content.{p}"))
    value = F.to_json(F.struct(at("title").alias("title"), at("employer.name").alias("employer"), at("applicationDue").alias("due"), F.coalesce(at("workLocations[0].municipal"), at("workLocations.municipal")).alias("municipality")))
    org = F.regexp_replace(at("employer.orgnr"), r"\D", "")
    rows = entries.where("ad_content is not null").select(org.alias("org"), F.lit("jobs").alias("family"), F.lit("job_posting").alias("field"), F.col("uuid").alias("value_key"), value.alias("value"), F.lit(None).cast("string").alias("period_end"), F.lit("current").alias("status"))
    return finish(rows.where(F.length("org") == 9))


def evidence(rows: DataFrame, url: Column, spans: Sequence[Column], limit: int = 500) -> DataFrame:
    """evidence_id, source_url and span: the distinct spans joined with ' | ', cut at the limit, each identity once."""
    span = F.substring(F.array_join(F.array_distinct(F.filter(F.array(*spans), lambda s: s.isNotNull() & (s != ""))), " | "), 1, limit)
    out = rows.select(url.alias("source_url"), span.alias("span")).where("source_url is not null")
    return out.distinct().select(keys.evidence_id(F.col("source_url"), F.col("span")).alias("evidence_id"), "source_url", "span")


def observed(claims: DataFrame, evidence_times: DataFrame) -> DataFrame:
    """claim_id with the first and last time at which its evidence was read.

    claims: claim_id, evidence_ids; evidence_times: evidence_id, retrieved_at. Claims without evidence have none.
    """
    links = claims.select("claim_id", F.explode("evidence_ids").alias("evidence_id")).distinct()
    return links.join(evidence_times, "evidence_id").groupBy("claim_id").agg(F.min("retrieved_at").alias("first_observed_at"), F.max("retrieved_at").alias("last_observed_at"))
