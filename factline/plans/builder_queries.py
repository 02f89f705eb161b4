"""Queries of claim builders, decision ladders, states and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pages
from ..functions import text as X
from ..functions.instants import instant
from ..operators import choosing, claims, ladders
from ..runtime import work_path
from ..sources.tables import files_stream
from ..streaming import feed
from .catalog import Catalog
from .claims_queries import SQL_ACCOUNTS, accounts
from .matching_queries import SQL_HOST, SQL_MS

catalog = Catalog()
query = catalog.query

SQL_ROLES = """
f AS (SELECT organisation_number AS org, arg_max(body, retrieved_at) AS body FROM register_roles WHERE status = 200 AND body IS NOT NULL GROUP BY 1),
g AS (SELECT org, unnest(body.rollegrupper) AS g FROM f), r AS (SELECT org, unnest(g.roller) AS r FROM g),
n AS (SELECT org, r.type.kode AS code, r.avregistrert AS gone, coalesce(nullif(concat_ws(' ', r.person.navn.fornavn, r.person.navn.mellomnavn, r.person.navn.etternavn), ''), array_to_string(r.enhet.navn, ' ')) AS name FROM r WHERE r IS NOT NULL)
"""


def _roles(t) -> DataFrame:
    rows = t("register_roles").where("status = 200 and body is not null").select(F.col("organisation_number").alias("org"), "retrieved_at", "body")
    return choosing.last_wins(rows, ["org"], F.col("retrieved_at")).select("org", "body")


@query(f"""
WITH {SQL_ROLES}
SELECT org, code || '|' || name AS value_key, CASE WHEN gone THEN 'withdrawn' ELSE 'current' END AS status, 'c_' || substr(sha256(org || '|leadership|role|' || code || '|' || name), 1, 20) AS claim_id FROM n WHERE name IS NOT NULL AND code IS NOT NULL
""")
def claims_roles(t) -> DataFrame:
    """Leadership claims from the role register."""
    return claims.roles(_roles(t)).select("org", "value_key", "status", "claim_id")


@query(f"""
WITH {SQL_ROLES}, c AS (SELECT org, g.sistEndret AS changed, g.type.kode AS code FROM g WHERE g.sistEndret IS NOT NULL), m AS (SELECT org, max(changed) AS changed FROM c GROUP BY 1)
SELECT org, changed, coalesce(string_agg(DISTINCT code, ',' ORDER BY code), '') AS groups FROM c JOIN m USING (org, changed) GROUP BY 1, 2
""")
def latest_role_change(t) -> DataFrame:
    """The latest change of roles of each organisation and the groups it touched."""
    return claims.latest_role_change(_roles(t))


@query(f"""
WITH {SQL_ACCOUNTS}, r AS (
  SELECT org, x.regnskapstype AS kind, x.regnskapsperiode.tilDato AS period_end, x.id AS id,
    [x.resultatregnskapResultat.driftsresultat.driftsinntekter.sumDriftsinntekter, x.resultatregnskapResultat.driftsresultat.driftsresultat, x.resultatregnskapResultat.aarsresultat, x.eiendeler.sumEiendeler,
      x.egenkapitalGjeld.egenkapital.sumEgenkapital, x.egenkapitalGjeld.gjeldOversikt.sumGjeld] AS v FROM a
), y AS (SELECT *, row_number() OVER (PARTITION BY org, kind, substr(period_end, 1, 4) ORDER BY period_end DESC, id DESC) AS n FROM r WHERE period_end IS NOT NULL AND kind IN ('SELSKAP', 'KONSERN')),
z AS (SELECT *, row_number() OVER (PARTITION BY org, kind ORDER BY substr(period_end, 1, 4) DESC) AS age FROM y WHERE n = 1),
u AS (SELECT org, kind, period_end, age, unnest(['revenue', 'operating_result', 'annual_result', 'total_assets', 'equity', 'debt']) AS m, unnest(v) AS amount FROM z)
SELECT org, CASE WHEN age = 1 THEN 'financials' ELSE 'financial_history' END AS family, CASE WHEN kind = 'KONSERN' THEN 'group_' ELSE '' END || m AS field, period_end, CAST(amount AS DOUBLE) AS amount FROM u WHERE amount IS NOT NULL
""")
def claims_financials(t) -> DataFrame:
    """Claims of the newest and earlier accounts, by metric."""
    rows = claims.financials(accounts(t))
    return rows.select("org", "family", "field", "period_end", F.get_json_object("value", "$.amount").cast("double").alias("amount"))


@query("""
WITH e AS (SELECT uuid, regexp_replace(json_extract_string(ad_content, '$.employer.orgnr'), '\\D', '', 'g') AS org FROM feed_entry WHERE ad_content IS NOT NULL)
SELECT org, count(DISTINCT uuid) AS ads FROM e WHERE length(org) = 9 GROUP BY 1
""")
def claims_jobs(t) -> DataFrame:
    """Ads of each employer, from feed entries."""
    return claims.postings(t("feed_entry")).groupBy("org").agg(F.countDistinct("value_key").alias("ads"))


@query("""
WITH x AS (SELECT claim_id, unnest(evidence_ids) AS e FROM claims WHERE claim_id IS NOT NULL), t AS (SELECT e, min(last_observed_at) AS ts FROM (SELECT unnest(evidence_ids) AS e, last_observed_at FROM claims) GROUP BY 1)
SELECT claim_id, CAST(min(ts) AS VARCHAR) AS first_observed_at, CAST(max(ts) AS VARCHAR) AS last_observed_at FROM x JOIN t USING (e) GROUP BY 1
""")
def evidence_times(t) -> DataFrame:
    """When the evidence of each claim was first and last read."""
    c = t("claims")
    times = c.select(F.explode("evidence_ids").alias("evidence_id"), "last_observed_at").groupBy("evidence_id").agg(F.min("last_observed_at").alias("retrieved_at"))
    out = claims.observed(c.where("claim_id is not null"), times)
    return out.select("claim_id", F.col("first_observed_at").cast("string").alias("first_observed_at"), F.col("last_observed_at").cast("string").alias("last_observed_at"))


VERDICT_SQL = f"""
WITH s AS (
  SELECT {SQL_HOST.format("employer_homepage")} AS domain, 'job_feed' AS kind FROM active_ads WHERE employer_homepage IS NOT NULL
  UNION SELECT {SQL_HOST.format("website")}, 'map' FROM osm WHERE website IS NOT NULL
  UNION SELECT {SQL_HOST.format("website")}, 'number' FROM osm WHERE website IS NOT NULL AND length(regexp_replace(orgnr, '\\D', '', 'g')) = 9
  UNION SELECT {SQL_HOST.format("w")}, 'place' FROM (SELECT unnest(from_json(websites, '["VARCHAR"]')) AS w FROM place) WHERE w IS NOT NULL
), g AS (SELECT domain, list(DISTINCT kind) AS kinds, count(DISTINCT kind) AS different FROM s GROUP BY 1)
SELECT domain, different, CASE WHEN list_contains(kinds, 'number') THEN 'exact' WHEN different >= 3 THEN 'exact' WHEN different = 2 THEN 'related' WHEN list_contains(kinds, 'map') THEN 'ambiguous' ELSE 'rejected' END AS verdict FROM g
"""


@query(VERDICT_SQL)
def verdict_ladder(t) -> DataFrame:
    """A verdict for each domain: the first rule that holds over the signals gathered for it."""
    h = X.host
    part = lambda rows, c, kind: rows.where(c.isNotNull()).select(h(c).alias("domain"), F.lit(kind).alias("kind"))
    o = t("osm")
    s = part(t("active_ads"), F.col("employer_homepage"), "job_feed").unionByName(part(o, F.col("website"), "map")).unionByName(part(o.where(F.length(X.digits(F.col("orgnr"))) == 9), F.col("website"), "number")).unionByName(part(t("place").select(F.explode(F.from_json("websites", "array<string>")).alias("w")), F.col("w"), "place"))
    rules = [("exact", ladders.has("number")), ("exact", F.col("different") >= 3), ("related", F.col("different") == 2), ("ambiguous", ladders.has("map"))]
    return ladders.gathered(s, ["domain"]).select("domain", "different", ladders.ladder(rules, "rejected").alias("verdict"))


@query("""
WITH s AS (
  SELECT organisation_number AS org, 'financials' AS family, status, len(body) = 0 AS empty, retrieved_at FROM register_accounts UNION ALL SELECT organisation_number, 'leadership', status, len(body.rollegrupper) = 0, retrieved_at FROM register_roles
), l AS (SELECT org, family, arg_max({'s': status, 'e': empty}, (retrieved_at, status)) AS x FROM s GROUP BY 1, 2),
a AS (SELECT org, family, CASE WHEN x.s IN (404, 410) THEN 'not_available' WHEN x.s IN (401, 403, 429) THEN 'blocked' WHEN x.s IS NULL OR x.s >= 400 THEN 'failed' WHEN x.e THEN 'not_available' ELSE 'available' END AS availability FROM l),
f AS (SELECT org, family, coalesce(availability, 'failed') AS availability FROM (SELECT DISTINCT org FROM a) CROSS JOIN (VALUES ('financials'), ('leadership')) v(family) LEFT JOIN a USING (org, family))
SELECT org, count_if(availability = 'failed') AS failed, count(*) AS families, CASE WHEN count_if(availability = 'failed') = 0 THEN 'completed' WHEN count_if(availability = 'failed') = count(*) THEN 'failed' ELSE 'partial' END AS status FROM f GROUP BY 1
""".replace("SELECT org, count_if(availability = 'failed') AS failed", "SELECT org, CAST(count_if(availability = 'failed') AS BIGINT) AS failed"))
def terminal_status(t) -> DataFrame:
    """How each organisation's run ended, from the states of its sources; missing states count as failed."""
    a = t("register_accounts").select(F.col("organisation_number").alias("org"), F.lit("financials").alias("family"), "status", (F.size("body") == 0).alias("empty"), "retrieved_at")
    r = t("register_roles").select(F.col("organisation_number").alias("org"), F.lit("leadership").alias("family"), "status", (F.size("body.rollegrupper") == 0).alias("empty"), "retrieved_at")
    last = choosing.last_wins(a.unionByName(r), ["org", "family"], F.col("retrieved_at"), F.col("status"))
    state = last.select("org", "family", ladders.availability(F.col("status"), F.lit(None), F.coalesce("empty", F.lit(False))).alias("availability"), F.lit(None).cast("string").alias("reason"))
    return ladders.terminal(ladders.filled(state, last, ["financials", "leadership"])).select("org", "failed", "families", "status")


STREAM_SQL = f"""
WITH e AS (SELECT DISTINCT uuid AS key, coalesce(status, '') AS status, {SQL_MS.format("sistendret")} AS at_ms FROM feed_entry WHERE uuid IS NOT NULL), g AS (SELECT * FROM e WHERE at_ms IS NOT NULL)
SELECT key, arg_max(status, (at_ms, status)) AS status, max(at_ms) AS at, min(at_ms) AS first_at, count(*) AS events FROM g GROUP BY 1
""".replace(" AS at,", ' AS "at",')


def _feed_events(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("uuid").alias("key"), F.coalesce("status", F.lit("")).alias("status"), F.unix_millis(instant(F.col("sistendret"))).alias("at"))


@query(STREAM_SQL)
def feed_state(t) -> DataFrame:
    """The feed's state by key, from the whole log."""
    return feed.batch_state(_feed_events(t("feed_entry")))


def feed_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same state, folded together by Structured Streaming in micro-batches."""
    stream = files_stream(spark, d, "feed_entry")
    state = feed.target(spark, work_path(spark, "feed-state"))
    feed.keep_up(_feed_events(stream), state, work_path(spark, "feed-offsets")).awaitTermination()
    return state.latest()


catalog.queries["feed_stream"], catalog.sql["feed_stream"] = feed_stream, STREAM_SQL


@query(f"""
SELECT {SQL_HOST.format("url")} AS host, count(*) AS pages, count(DISTINCT final_url) AS targets, CAST(coalesce(count_if({SQL_HOST.format("url")} <> {SQL_HOST.format("final_url")}), 0) AS BIGINT) AS elsewhere FROM page_fetch WHERE url IS NOT NULL GROUP BY 1
""")
def redirects(t) -> DataFrame:
    """Pages of each host, where they lead, and how many leave it."""
    a, b = X.host(F.col("url")), X.host(F.col("final_url"))
    return t("page_fetch").where("url is not null").groupBy(a.alias("host")).agg(F.count("*").alias("pages"), F.countDistinct("final_url").alias("targets"), F.count_if(a != b).alias("elsewhere"))


@query()
def page_profiles(t) -> DataFrame:
    """Own links of pages with the rank of each, the best four of a page, by host."""
    rows = t("page_fetch").where("html is not null and url is not null").select("page_id", "host", F.explode(pages.over(pages.own_links, pages.TEXTS)("html", "url")).alias("link"))
    return rows.groupBy("host").agg(F.countDistinct("link").alias("links"), F.countDistinct("page_id").alias("pages"))
