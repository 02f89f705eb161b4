"""Queries of aggregates, claims, refresh, validation, scoring, directory and summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates, keys, maths
from ..functions import text as X
from ..operators import choosing, directory, quality, refresh, stats
from ..operators.snapshot_diff import canonical_json
from .catalog import Catalog, newest
from .matching_queries import REGISTER, SQL_SITE, register

catalog = Catalog()
query = catalog.query

VOLATILE = ["checked_at", "retrieved_at", "fetched_at", "observed_at", "last_checked"]
SQL_CANON = (
    "CASE WHEN json_type({0}) = 'OBJECT' THEN '{{' || coalesce((SELECT string_agg('\"' || m || '\":' || CAST(json_extract({0}, '$.\"' || m || '\"') AS VARCHAR), ',' ORDER BY m)"
    " FROM unnest(list_filter(json_keys({0}), lambda x: x NOT IN ('checked_at', 'retrieved_at', 'fetched_at', 'observed_at', 'last_checked'))) AS u(m)), '') || '}}' ELSE CAST(CAST({0} AS JSON) AS VARCHAR) END"
)
#: One row for each claim of a snapshot, as the comparison takes it.
#: Claims before (pr) and after (cr) of every pair of consecutive snapshots; s is the later one.
SQL_RUNS = f"""
n AS (SELECT s, lag(s) OVER (ORDER BY s) AS before FROM (SELECT DISTINCT snapshot_no AS s FROM claims WHERE snapshot_no IS NOT NULL)),
k AS (
  SELECT snapshot_no AS s, organisation_number AS org, family, field, coalesce(value_key, '') AS value_key,
    arg_max({{'v': {SQL_CANON.format("value")}, 'a': reporting_period.start, 'b': reporting_period.end, 't': status}}, (last_observed_at, value)) AS r
  FROM claims WHERE status IS NOT NULL AND value IS NOT NULL GROUP BY ALL
), st AS (SELECT DISTINCT snapshot_no AS s, organisation_number AS org, family, TRUE AS checked FROM claims WHERE availability IN ('available', 'not_available', 'not_applicable')),
p AS (SELECT n.s, org, family, field, value_key, r FROM k JOIN n ON k.s = n.before WHERE r.t = 'current'), c AS (SELECT n.s, org, family, field, value_key, r FROM k JOIN n USING (s) WHERE n.before IS NOT NULL AND r.t = 'current'),
m AS (
  SELECT s, org, family, field, value_key, p.r AS pr, c.r AS cr, coalesce(st.checked, FALSE) AS checked,
    CASE WHEN field = 'official_website'
      THEN {SQL_SITE.format("coalesce(json_extract_string(p.r.v, '$.url'), json_extract_string(p.r.v, '$'))")} IS NOT DISTINCT FROM {SQL_SITE.format("coalesce(json_extract_string(c.r.v, '$.url'), json_extract_string(c.r.v, '$'))")}
      ELSE (p.r.v IS NOT DISTINCT FROM c.r.v AND p.r.a IS NOT DISTINCT FROM c.r.a AND p.r.b IS NOT DISTINCT FROM c.r.b)
        OR (family = 'description' AND trim(regexp_replace(regexp_replace(lower(trim(json_extract_string(p.r.v, '$'))), '[^\\pL\\pN_\\s]', '', 'g'), '\\s+', ' ', 'g'))
          IS NOT DISTINCT FROM trim(regexp_replace(regexp_replace(lower(trim(json_extract_string(c.r.v, '$'))), '[^\\pL\\pN_\\s]', '', 'g'), '\\s+', ' ', 'g'))) END AS same
  FROM p FULL OUTER JOIN c USING (s, org, family, field, value_key) LEFT JOIN st USING (s, org, family)
)
"""


def runs(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Claims before and after and the families checked of every pair of consecutive snapshots, by the later snapshot_no."""
    rows = t("claims").where("snapshot_no is not null")
    pairs = rows.select("snapshot_no").distinct().withColumn("before", F.lag("snapshot_no").over(W.orderBy("snapshot_no"))).where("before is not null")
    pairs = F.broadcast(pairs)  # as many rows as there are snapshots
    claims = rows.where("status is not null and value is not null").select(
        "snapshot_no", F.col("organisation_number").alias("org"), "family", "field", F.coalesce("value_key", F.lit("")).alias("value_key"), canonical_json(F.col("value"), VOLATILE).alias("canon"),
        F.col("reporting_period.start").alias("period_start"), F.col("reporting_period.end").alias("period_end"), "status", "last_observed_at", F.col("value").alias("raw"),
    )
    best = choosing.last_wins(claims, ["snapshot_no", "org", "family", "field", "value_key"], F.col("last_observed_at"), F.col("raw")).withColumnRenamed("canon", "value")
    before = best.withColumnRenamed("snapshot_no", "before").join(pairs, "before").drop("before")
    after = best.join(pairs.select("snapshot_no"), "snapshot_no")
    seen = rows.where(refresh.checked(F.col("availability"), F.lit(None).cast("string")))
    return before, after, seen.select("snapshot_no", F.col("organisation_number").alias("org"), "family").distinct().withColumn("checked", F.lit(True))


@query(f"""
WITH {SQL_RUNS}, x AS (
  SELECT s, org, family, field, value_key, pr.v AS prev_value, cr.v AS curr_value,
    CASE WHEN pr IS NOT NULL AND cr IS NOT NULL THEN CASE WHEN same THEN NULL WHEN family IN ('financials', 'financial_history') AND NOT coalesce(cr.b > coalesce(pr.b, ''), FALSE) THEN 'changed_value'
        WHEN family = 'website' THEN 'changed_website' WHEN family = 'description' THEN 'changed_description' WHEN family = 'identity' THEN 'identity_changed' WHEN family IN ('financials', 'financial_history') THEN 'new_filing' ELSE 'changed_value' END
      WHEN cr IS NOT NULL THEN CASE WHEN value_key <> '' THEN CASE family WHEN 'leadership' THEN 'new_role' WHEN 'jobs' THEN 'new_job' WHEN 'locations' THEN 'new_location' WHEN 'profiles' THEN 'new_profile' WHEN 'activity' THEN 'new_activity' END
        WHEN family = 'website' THEN 'changed_website' WHEN family = 'description' THEN 'changed_description' WHEN family = 'identity' THEN 'identity_changed' WHEN family IN ('financials', 'financial_history') THEN 'new_filing' ELSE 'changed_value' END
      WHEN family = 'activity' OR NOT checked THEN NULL
      WHEN value_key <> '' THEN CASE family WHEN 'leadership' THEN 'ended_role' WHEN 'jobs' THEN 'closed_job' WHEN 'locations' THEN 'closed_location' WHEN 'profiles' THEN 'removed_profile' END
      WHEN family = 'website' THEN 'changed_website' WHEN family = 'description' THEN 'changed_description' WHEN family = 'identity' THEN 'identity_changed' WHEN family IN ('financials', 'financial_history') THEN 'new_filing' ELSE 'changed_value' END AS change_type
  FROM m
)
SELECT s AS snapshot_no, org, family, field, value_key, change_type FROM x WHERE change_type IS NOT NULL
""")
def refresh_diff(t) -> DataFrame:
    """Typed changes between every two consecutive runs."""
    return refresh.changes(*runs(t), by=["snapshot_no"]).select("snapshot_no", "org", "family", "field", "value_key", "change_type")


@query(f"""
WITH {SQL_RUNS}
SELECT s AS snapshot_no, family, CASE WHEN pr IS NOT NULL AND cr IS NOT NULL THEN CASE WHEN same THEN 'kept' ELSE 'superseded' END WHEN cr IS NOT NULL THEN 'new'
  WHEN NOT checked THEN 'carried' WHEN family = 'activity' THEN 'withdrawn' ELSE 'ended' END AS origin, count(*) AS claims
FROM m GROUP BY 1, 2, 3
""")
def refresh_carry_forward(t) -> DataFrame:
    """Where the claims of the state after each run come from, by family."""
    return refresh.merged(*runs(t), by=["snapshot_no"]).groupBy("snapshot_no", "family", "origin").agg(F.count("*").alias("claims"))


@query("""
WITH k AS (SELECT organisation_number AS org, family, field, coalesce(value_key, '') AS value_key, min(snapshot_no) AS first_seen, max(snapshot_no) AS last_seen, count(DISTINCT snapshot_no) AS seen, count(DISTINCT status) AS statuses FROM claims GROUP BY ALL)
SELECT family, first_seen, last_seen, count(*) AS claims, CAST(sum(CASE WHEN seen < last_seen - first_seen + 1 THEN 1 ELSE 0 END) AS BIGINT) AS interrupted, max(statuses) AS most_statuses FROM k GROUP BY 1, 2, 3
""")
def refresh_history(t) -> DataFrame:
    """When claims were first and last seen, and how many were missing in between."""
    rows = t("claims").groupBy(F.col("organisation_number").alias("org"), "family", "field", F.coalesce("value_key", F.lit("")).alias("value_key")).agg(
        F.min("snapshot_no").alias("first_seen"), F.max("snapshot_no").alias("last_seen"), F.count_distinct("snapshot_no").alias("seen"), F.count_distinct("status").alias("statuses")
    )
    gap = F.count_if(F.col("seen") < F.col("last_seen") - F.col("first_seen") + 1)
    return rows.groupBy("family", "first_seen", "last_seen").agg(F.count("*").alias("claims"), gap.alias("interrupted"), F.max("statuses").alias("most_statuses"))


@query(f"SELECT snapshot_no, change_type, count(*) AS changes, count(DISTINCT org) AS organisations, count(DISTINCT (org, family, field, value_key)) AS ids FROM ({catalog.sql['refresh_diff']}) GROUP BY 1, 2")
def change_summary(t) -> DataFrame:
    """Changes of every run by type with the organisations concerned, most frequent first."""
    found = refresh.changes(*runs(t), by=["snapshot_no"])
    return found.groupBy("snapshot_no", "change_type").agg(F.count("*").alias("changes"), F.countDistinct("org").alias("organisations"), F.countDistinct("change_id").alias("ids")).orderBy("snapshot_no", F.desc("changes"), "change_type")


@query("""
SELECT family, count(*) AS claims, CAST(count_if(claim_id = 'c_' || substr(sha256(organisation_number || '|' || family || '|' || field || '|' || coalesce(value_key, '')), 1, 20)) AS BIGINT) AS agreeing,
  CAST(count_if(claim_id IS NULL) AS BIGINT) AS missing FROM claims GROUP BY 1
""")
def claim_ids(t) -> DataFrame:
    """Identities computed anew, compared with those delivered."""
    own = keys.claim_id(F.col("organisation_number"), F.col("family"), F.col("field"), F.col("value_key"))
    return t("claims").groupBy("family").agg(F.count("*").alias("claims"), F.count_if(F.col("claim_id") == own).alias("agreeing"), F.count_if(F.col("claim_id").isNull()).alias("missing"))


@query(f"""
WITH {REGISTER}, u AS (
  SELECT org, unnest(['legal_name', 'legal_form', 'postcode', 'municipality', 'employees', 'website']) AS field,
    unnest([b.navn, b.organisasjonsform.kode, b.postadresse.postnummer, b.postadresse.kommune, CAST(b.antallAnsatte AS VARCHAR), b.hjemmeside]) AS value FROM reg
)
SELECT org, field, value, 'c_' || substr(sha256(org || '|identity|' || field || '|'), 1, 20) AS claim_id FROM u WHERE value IS NOT NULL
""")
def claims_unpivot(t) -> DataFrame:
    """Identity claims in long form from the nested register body."""
    b = lambda c: F.col(f"body.{c}")
    fields = {"legal_name": b("navn"), "legal_form": b("organisasjonsform.kode"), "postcode": b("postadresse.postnummer"), "municipality": b("postadresse.kommune"), "employees": b("antallAnsatte"), "website": b("hjemmeside")}
    long = directory.unpivot(register(t), ["org"], fields)
    return long.withColumn("claim_id", keys.claim_id(F.col("org"), F.lit("identity"), F.col("field"), F.lit("")))


SQL_ACCOUNTS = """
f AS (SELECT organisation_number AS org, arg_max(body, retrieved_at) AS body FROM register_accounts WHERE status = 200 AND body IS NOT NULL GROUP BY 1),
a AS (SELECT org, x FROM (SELECT org, unnest(body) AS x FROM f) WHERE x IS NOT NULL)
"""


def accounts(t) -> DataFrame:
    """org and x, one row for each account of the latest fetch."""
    rows = t("register_accounts").where("status = 200 and body is not null").select(F.col("organisation_number").alias("org"), "retrieved_at", "body")
    latest = choosing.last_wins(rows, ["org"], F.col("retrieved_at"))
    return latest.select("org", F.explode("body").alias("x")).where("x is not null")


@query(f"""
WITH {SQL_ACCOUNTS}, r AS (SELECT org, x.regnskapstype AS kind, x.regnskapsperiode.tilDato AS period_end, x.id AS id FROM a WHERE x.regnskapsperiode.tilDato IS NOT NULL AND x.regnskapstype IS NOT NULL),
y AS (SELECT *, row_number() OVER (PARTITION BY org, kind, substr(period_end, 1, 4) ORDER BY period_end DESC, id DESC) AS n FROM r)
SELECT org, kind, max(period_end) AS latest, count(*) AS years, string_agg(substr(period_end, 1, 4), ',' ORDER BY period_end DESC) AS filed FROM y WHERE n = 1 GROUP BY 1, 2
""")
def latest_filing_per_type(t) -> DataFrame:
    """Newest accounts of each kind, and the years filed, each once."""
    rows = accounts(t).select("org", F.col("x.regnskapstype").alias("kind"), F.col("x.regnskapsperiode.tilDato").alias("period_end"), F.col("x.id").alias("id")).where("period_end is not null and kind is not null")
    once = choosing.last_wins(rows.withColumn("year", F.substring("period_end", 1, 4)), ["org", "kind", "year"], F.col("period_end"), F.col("id"))
    years = F.array_join(F.reverse(F.array_sort(F.collect_list("year"))), ",")
    return once.groupBy("org", "kind").agg(F.max("period_end").alias("latest"), F.count("*").alias("years"), years.alias("filed"))


@query(f"""
WITH {SQL_ACCOUNTS}, r AS (SELECT org, substr(x.regnskapsperiode.tilDato, 1, 4) AS year, max(x.resultatregnskapResultat.driftsresultat.driftsinntekter.sumDriftsinntekter) AS amount FROM a WHERE x.regnskapstype = 'SELSKAP' GROUP BY 1, 2),
s AS (SELECT org, year, amount, lag(amount) OVER (PARTITION BY org ORDER BY year) AS before FROM r WHERE amount IS NOT NULL AND year IS NOT NULL)
SELECT org, year, amount, round((amount - before) / nullif(abs(before), 0) * 100, 4) AS pct_change FROM s
""")
def series_pct_change(t) -> DataFrame:
    """Revenue by year with the change to the year before."""
    rows = accounts(t).where("x.regnskapstype = 'SELSKAP'").groupBy("org", F.substring("x.regnskapsperiode.tilDato", 1, 4).alias("year")).agg(F.max("x.resultatregnskapResultat.driftsresultat.driftsinntekter.sumDriftsinntekter").alias("amount"))
    rows = rows.where("amount is not null and year is not null")
    before = F.lag("amount").over(W.partitionBy("org").orderBy("year"))
    return rows.withColumn("pct_change", F.round(maths.pct_change(before, F.col("amount")), 4))


@query(f"""
WITH {SQL_ACCOUNTS}, r AS (
  SELECT org, x.id AS id, x.resultatregnskapResultat.driftsresultat.driftsresultat / nullif(x.resultatregnskapResultat.driftsresultat.driftsinntekter.sumDriftsinntekter, 0) * 100 AS margin,
    x.egenkapitalGjeld.egenkapital.sumEgenkapital / nullif(x.eiendeler.sumEiendeler, 0) * 100 AS ratio FROM a
)
SELECT org, id, round(margin, 3) AS margin, round(ratio, 3) AS equity_ratio, CASE WHEN ratio >= 40 THEN 'strong' WHEN ratio >= 15 THEN 'moderate' WHEN ratio IS NOT NULL THEN 'thin' END AS band FROM r
""")
def ratio_bands(t) -> DataFrame:
    """Operating margin and equity ratio with its band, of each account."""
    x = lambda c: F.col(f"x.{c}")
    op = x("resultatregnskapResultat.driftsresultat.driftsresultat")
    margin = op / F.nullif(x("resultatregnskapResultat.driftsresultat.driftsinntekter.sumDriftsinntekter"), F.lit(0.0)) * 100
    ratio = x("egenkapitalGjeld.egenkapital.sumEgenkapital") / F.nullif(x("eiendeler.sumEiendeler"), F.lit(0.0)) * 100
    return accounts(t).select("org", x("id").alias("id"), F.round(margin, 3).alias("margin"), F.round(ratio, 3).alias("equity_ratio"), maths.equity_band(ratio).alias("band"))


@query("""
WITH y AS (SELECT o_custkey, year(o_orderdate) AS year, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2),
m AS (SELECT *, min(total) OVER (PARTITION BY o_custkey) AS lo, max(total) OVER (PARTITION BY o_custkey) AS hi FROM y)
SELECT o_custkey, CAST(year AS INT) AS year, round(CASE WHEN hi = lo THEN 1.0 ELSE (total - lo) / (hi - lo) END, 4) AS height FROM m
""")
def minmax_normalise(t) -> DataFrame:
    """A series scaled between its least and greatest value."""
    y = t("orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("total"))
    w = W.partitionBy("o_custkey")
    return y.select("o_custkey", "year", F.round(maths.min_max(F.col("total"), F.min("total").over(w), F.max("total").over(w)), 4).alias("height"))


AVAILABILITY = ["available", "not_available", "not_applicable", "ambiguous", "blocked", "failed"]


@query(
    "WITH f AS (SELECT unnest(["
    + ", ".join(f"'{f}'" for f in quality.FAMILIES)
    + "]) AS family) SELECT f.family, "
    + ", ".join(f"CAST(coalesce(count_if(availability = '{a}'), 0) AS BIGINT) AS {a}" for a in AVAILABILITY)
    + " FROM f LEFT JOIN claims ON f.family = claims.family GROUP BY 1"
)
def family_state_counts(t) -> DataFrame:
    """Families by availability, with zeros for families and states that don't occur."""
    return quality.zero_filled(t("claims").select("family", "availability"), "family", quality.FAMILIES, "availability", AVAILABILITY)


@query("SELECT coalesce(page_kind, 'none') AS purpose, CAST(sum(1 + coalesce(len(redirect_chain), 0)) AS BIGINT) AS requests, count(*) AS fetches FROM page_fetch GROUP BY 1")
def requests_by_purpose(t) -> DataFrame:
    """Requests used by purpose, redirects included."""
    n = F.lit(1) + F.coalesce(F.size("redirect_chain"), F.lit(0))
    return t("page_fetch").groupBy(F.coalesce("page_kind", F.lit("none")).alias("purpose")).agg(F.sum(n).alias("requests"), F.count("*").alias("fetches"))


@query("""
WITH o AS (SELECT l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
s AS (SELECT unnest([0.5, 0.95]) AS share)
SELECT l_returnflag, CAST(share AS DOUBLE) AS share, l_extendedprice FROM o, s WHERE r = round_even(share * (n - 1), 0) + 1
""")
def nearest_rank_percentile(t) -> DataFrame:
    """Median and 95th percentile by the nearest rank, half-even."""
    return stats.nearest_ranks(t("lineitem"), ["l_returnflag"], "l_extendedprice", [0.5, 0.95])


@query("""
WITH s AS (SELECT count(DISTINCT organisation_number) AS companies, count(DISTINCT CASE WHEN page_kind = 'homepage' AND NOT ok THEN organisation_number END) AS identity_failed,
  count(*) AS requests, CAST(count_if(error IS NOT NULL) AS BIGINT) AS connection_failures FROM page_fetch)
SELECT companies, identity_failed, requests, connection_failures, round_even(connection_failures / greatest(requests, 1), 3) AS connection_failure_share,
  identity_failed / greatest(companies, 1) > 0.02 OR connection_failures / greatest(requests, 1) > 0.15 AS degraded,
  concat_ws('; ', CASE WHEN identity_failed / greatest(companies, 1) > 0.02 THEN 'registry lookup failed for ' || identity_failed || ' of ' || companies || ' companies' END,
    CASE WHEN connection_failures / greatest(requests, 1) > 0.15 THEN connection_failures || ' of ' || requests || ' requests failed at the connection level' END) AS reasons FROM s
""")
def run_health(t) -> DataFrame:
    """Shares of failures in a run and whether it counts as degraded."""
    failed = F.countDistinct(F.when((F.col("page_kind") == "homepage") & ~F.col("ok"), F.col("organisation_number")))
    return quality.health(t("page_fetch"), F.countDistinct("organisation_number"), failed, F.count("*"), F.count_if(F.col("error").isNotNull()))


@query("""
SELECT family, CAST(count_if(availability = 'available') AS BIGINT) AS available, CAST(count_if(availability IN ('not_available', 'not_applicable', 'ambiguous')) AS BIGINT) AS not_available,
  CAST(count_if(availability IN ('blocked', 'failed')) AS BIGINT) AS blocked_or_failed, round_even(count_if(availability = 'available') / count(*), 4) AS available_rate FROM claims GROUP BY 1
""")
def coverage_rates(t) -> DataFrame:
    """Available, unavailable and failed claims by family, with the rate."""
    a, n = F.count_if(F.col("availability") == "available"), F.count("*")
    return t("claims").groupBy("family").agg(
        a.alias("available"), F.count_if(F.col("availability").isin("not_available", "not_applicable", "ambiguous")).alias("not_available"),
        F.count_if(F.col("availability").isin("blocked", "failed")).alias("blocked_or_failed"), F.bround(a / n, 4).alias("available_rate"),
    )


@query("SELECT snapshot_no, round_even(avg(CASE WHEN availability IN ('not_available', 'ambiguous') THEN 1.0 ELSE 0.0 END), 4) AS abstention FROM claims WHERE family IN ('website', 'profiles', 'activity', 'jobs') AND availability IS NOT NULL GROUP BY 1")
def abstention_rate(t) -> DataFrame:
    """Share of external facts that abstain, by snapshot."""
    rows = t("claims").where(F.col("family").isin(*quality.EXTERNAL) & F.col("availability").isNotNull())
    return rows.groupBy("snapshot_no").agg(F.bround(F.avg(F.col("availability").isin("not_available", "ambiguous").cast("double")), 4).alias("abstention"))


@query(f"""
WITH {REGISTER}, g AS (SELECT org, {SQL_SITE.format("b.hjemmeside")} AS gold FROM reg),
p AS (SELECT organisation_number AS org, max({SQL_SITE.format("json_extract_string(value, '$.url')")}) AS ours FROM claims WHERE field = 'official_website' AND snapshot_no = (SELECT max(snapshot_no) FROM claims) AND value IS NOT NULL GROUP BY 1)
SELECT CAST(count_if(coalesce(ours, '') <> '') AS BIGINT) AS published, CAST(count_if(gold <> '') AS BIGINT) AS truth, CAST(count_if(ours = gold AND gold <> '') AS BIGINT) AS correct,
  round_even(count_if(ours = gold AND gold <> '') / nullif(count_if(coalesce(ours, '') <> ''), 0), 4) AS precision, round_even(count_if(ours = gold AND gold <> '') / nullif(count_if(gold <> ''), 0), 4) AS recall
FROM g LEFT JOIN p USING (org)
""")
def precision_recall(t) -> DataFrame:
    """Published sites against the register's, as counts, precision and recall."""
    gold = register(t).select("org", X.site_key(F.col("body.hjemmeside")).alias("gold"))
    ours = newest(t("claims")).where("field = 'official_website' and value is not null").groupBy(F.col("organisation_number").alias("org")).agg(F.max(X.site_key(F.get_json_object("value", "$.url"))).alias("ours"))
    rows = gold.join(ours, "org", "left").withColumn("ours", F.coalesce("ours", F.lit("")))
    return quality.precision_recall(rows, [], F.col("ours") != "", F.col("gold") != "", F.col("ours") == F.col("gold"))


@query("""
WITH e AS (SELECT user_id, list(DISTINCT event_type) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS a, list(DISTINCT event_type) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS b FROM events GROUP BY 1),
s AS (SELECT sum(len(list_intersect(a, b))) AS hits, sum(coalesce(len(a), 0)) AS expected, sum(coalesce(len(b), 0)) AS produced FROM e)
SELECT CAST(coalesce(hits, 0) AS BIGINT) AS hits, CAST(expected AS BIGINT) AS expected, CAST(produced AS BIGINT) AS produced, round_even(coalesce(hits, 0) / produced, 4) AS precision, round_even(coalesce(hits, 0) / expected, 4) AS recall FROM s
""")
def set_micro_pr(t) -> DataFrame:
    """Micro precision and recall over sets: event types of a user's first and second half month."""
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    first, second = F.collect_set(F.when(F.col("ts").cast("timestamp_ntz") < cut, F.col("event_type"))), F.collect_set(F.when(F.col("ts").cast("timestamp_ntz") >= cut, F.col("event_type")))
    return quality.micro_sets(t("events").groupBy("user_id").agg(first.alias("a"), second.alias("b")), "a", "b")


WEIGHTS = {"website": 0.35, "profiles": 0.2, "activity": 0.2, "jobs": 0.25}


@query("""
WITH f AS (SELECT family, count_if(availability = 'available') / count(*) AS v FROM claims WHERE family IN ('website', 'profiles', 'activity', 'jobs') GROUP BY 1),
w AS (SELECT *, CASE family WHEN 'website' THEN 0.35 WHEN 'profiles' THEN 0.2 WHEN 'activity' THEN 0.2 ELSE 0.25 END AS w FROM f)
SELECT round(sum(w * v) / sum(w), 6) AS weighted_recall, round(least(40.0, 40.0 * sum(w * v) / sum(w) + 5), 6) AS points FROM w
""")
def weighted_recall(t) -> DataFrame:
    """Weighted mean over families and capped points."""
    f = t("claims").where(F.col("family").isin(*WEIGHTS)).groupBy("family").agg((F.count_if(F.col("availability") == "available") / F.count("*")).alias("v"))
    w = F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("family"))
    mean = f.agg(quality.weighted_mean(F.col("v"), w).alias("m"))
    return mean.select(F.round("m", 6).alias("weighted_recall"), F.round(F.least(F.lit(40.0), F.col("m") * 40.0 + 5), 6).alias("points"))


@query("""
SELECT rule, count(*) AS claims FROM (
  SELECT unnest([CASE WHEN claim_id IS NULL THEN 'no claim id' END, CASE WHEN availability = 'available' AND value IS NULL THEN 'available without value' END,
    CASE WHEN availability <> 'available' AND value IS NOT NULL AND NOT (availability = 'ambiguous' AND relationship IS NOT NULL) THEN 'value though not available' END,
    CASE WHEN evidence_ids IS NULL OR len(evidence_ids) = 0 THEN 'no evidence' END, CASE WHEN first_observed_at > last_observed_at THEN 'observed backwards' END,
    CASE WHEN confidence < 0 OR confidence > 1 THEN 'confidence out of range' END]) AS rule FROM claims
) WHERE rule IS NOT NULL GROUP BY 1
""")
def contract_violations(t) -> DataFrame:
    """Broken invariants of claims, by rule."""
    c = F.col
    rules: dict[str, Column] = {
        "no claim id": c("claim_id").isNull(), "available without value": (c("availability") == "available") & c("value").isNull(),
        "value though not available": (c("availability") != "available") & c("value").isNotNull() & ~((c("availability") == "ambiguous") & c("relationship").isNotNull()),
        "no evidence": c("evidence_ids").isNull() | (F.size("evidence_ids") == 0), "observed backwards": c("first_observed_at") > c("last_observed_at"),
        "confidence out of range": (c("confidence") < 0) | (c("confidence") > 1),
    }
    return quality.violations(t("claims"), ["claim_id"], rules).groupBy("rule").agg(F.count("*").alias("claims"))


@query("""
WITH i AS (SELECT DISTINCT employer_orgnr AS org FROM active_ads WHERE employer_orgnr IS NOT NULL), o AS (SELECT organisation_number AS org, snapshot_no FROM claims WHERE family = 'identity' AND field = 'legal_name')
SELECT snapshot_no, count(*) AS produced, count(*) - count(DISTINCT org) AS duplicates, (SELECT count(*) FROM i) AS asked,
  CAST((SELECT count(*) FROM i) AS BIGINT) - count(DISTINCT CASE WHEN org IN (SELECT org FROM i) THEN org END) AS dropped FROM o GROUP BY 1
""")
def batch_checks(t) -> DataFrame:
    """Of a batch: rows produced, duplicates, and inputs that got none."""
    asked = t("active_ads").select(F.col("employer_orgnr").alias("org")).where("org is not null").distinct()
    n = asked.count()
    rows = t("claims").where("family = 'identity' and field = 'legal_name'").select(F.col("organisation_number").alias("org"), "snapshot_no")
    rows = rows.join(asked.withColumn("hit", F.lit(True)), "org", "left")
    return rows.groupBy("snapshot_no").agg(
        F.count("*").alias("produced"), (F.count("*") - F.countDistinct("org")).alias("duplicates"), F.lit(n).cast("long").alias("asked"), (F.lit(n).cast("long") - F.countDistinct(F.when(F.col("hit"), F.col("org")))).alias("dropped")
    )


@query("""
WITH s AS (SELECT family, count_if(availability = 'available' AND snapshot_no = (SELECT max(snapshot_no) FROM claims WHERE snapshot_no < (SELECT max(snapshot_no) FROM claims))) / nullif(count_if(snapshot_no = (SELECT max(snapshot_no) FROM claims WHERE snapshot_no < (SELECT max(snapshot_no) FROM claims))), 0) AS baseline, count_if(availability = 'available' AND snapshot_no = (SELECT max(snapshot_no) FROM claims)) / nullif(count_if(snapshot_no = (SELECT max(snapshot_no) FROM claims)), 0) AS challenger FROM claims GROUP BY 1)
SELECT family, round(baseline, 6) AS baseline, round(challenger, 6) AS challenger, CASE WHEN challenger < baseline THEN 'REJECT' WHEN challenger > baseline + 0.01 THEN 'PROMOTE' ELSE 'HOLD' END AS decision FROM s
""")
def promotion_decision(t) -> DataFrame:
    """Whether a run promotes, holds or rejects what the run before had, by family."""
    part = lambda n: F.count_if((F.col("availability") == "available") & (F.col("snapshot_no") == n)) / F.nullif(F.count_if(F.col("snapshot_no") == n), F.lit(0).cast("long"))
    last = t("claims").agg(F.max("snapshot_no")).scalar()
    before = t("claims").where(F.col("snapshot_no") < last).agg(F.max("snapshot_no")).scalar()
    s = t("claims").groupBy("family").agg(part(before).alias("baseline"), part(last).alias("challenger"))
    return s.withColumn("decision", quality.decide("baseline", "challenger", 0.01)).select("family", F.round("baseline", 6).alias("baseline"), F.round("challenger", 6).alias("challenger"), "decision")


DIRECTORY_SQL = f"""
WITH {REGISTER}, c AS (
  SELECT organisation_number AS org, CAST(count_if(family = 'profiles') AS BIGINT) AS profiles, CAST(count_if(family = 'jobs') AS BIGINT) AS jobs, CAST(count_if(family = 'activity') AS BIGINT) AS activity,
    count(DISTINCT CASE WHEN availability = 'available' THEN family END) AS coverage, max(CASE WHEN field = 'revenue' THEN CAST(json_extract_string(value, '$.amount') AS DOUBLE) END) AS revenue
  FROM claims WHERE snapshot_no = (SELECT max(snapshot_no) FROM claims) GROUP BY 1
), dir AS (
  SELECT reg.org, b.navn AS name, b.organisasjonsform.kode AS legal_form, b.postadresse.kommune AS municipality, b.naeringskode1.beskrivelse AS industry, b.antallAnsatte AS employees, b.hjemmeside AS website,
    coalesce(profiles, 0) AS profiles, coalesce(jobs, 0) AS jobs, coalesce(activity, 0) AS activity, coalesce(coverage, 0) AS coverage, revenue,
    CASE WHEN b.antallAnsatte IS NULL THEN 'unknown' WHEN b.antallAnsatte <= 0 THEN '0' WHEN b.antallAnsatte < 5 THEN '1-4' WHEN b.antallAnsatte < 20 THEN '5-19' WHEN b.antallAnsatte < 50 THEN '20-49' WHEN b.antallAnsatte < 250 THEN '50-249' ELSE '250+' END AS band
  FROM reg LEFT JOIN c USING (org)
)
"""


def directory_table(t) -> DataFrame:
    """One wide row for each organisation: the register's facts and counts of claims."""
    fam = lambda f: F.count_if(F.col("family") == f)
    c = newest(t("claims")).groupBy(F.col("organisation_number").alias("org")).agg(
        fam("profiles").alias("profiles"), fam("jobs").alias("jobs"), fam("activity").alias("activity"), F.countDistinct(F.when(F.col("availability") == "available", F.col("family"))).alias("coverage"),
        F.max(F.when(F.col("field") == "revenue", F.get_json_object("value", "$.amount").try_cast("double"))).alias("revenue"),
    )
    b = lambda n: F.col(f"body.{n}")
    rows = register(t).select(
        "org", b("navn").alias("name"), b("organisasjonsform.kode").alias("legal_form"), b("postadresse.kommune").alias("municipality"), b("naeringskode1.beskrivelse").alias("industry"),
        b("antallAnsatte").alias("employees"), b("hjemmeside").alias("website"),
    )
    return rows.join(c, "org", "left").na.fill(0, ["profiles", "jobs", "activity", "coverage"]).withColumn("band", maths.employee_band(F.col("employees")))


@query(DIRECTORY_SQL + "SELECT org, name, legal_form, municipality, employees, profiles, jobs, activity, coverage, revenue, band FROM dir")
def directory_rows(t) -> DataFrame:
    """The directory: one wide row for each organisation."""
    return directory_table(t).select("org", "name", "legal_form", "municipality", "employees", "profiles", "jobs", "activity", "coverage", "revenue", "band")


@query(DIRECTORY_SQL + "SELECT 'legal_form' AS facet, legal_form AS value, count(*) AS count FROM dir WHERE legal_form IS NOT NULL GROUP BY 2 UNION ALL SELECT 'band', band, count(*) FROM dir GROUP BY 2")
def facets(t) -> DataFrame:
    """Values of the directory's facets with counts."""
    return directory.facets(directory_table(t), ["legal_form", "band"])


@query(DIRECTORY_SQL + "SELECT org, name, coverage FROM dir WHERE contains(lower(concat_ws(' ', name, org, municipality, industry)), 'barnehage') AND coverage >= 2")
def directory_search(t) -> DataFrame:
    """Organisations by a term in name, number, place or industry, and well covered."""
    return directory.search(directory_table(t), "Barnehage", ["name", "org", "municipality", "industry"]).where("coverage >= 2").select("org", "name", "coverage")


@query(DIRECTORY_SQL + "SELECT org, name, coverage FROM dir WHERE contains(lower(strip_accents(replace(replace(coalesce(name, ''), 'Ø', 'O'), 'ø', 'o'))), 'fj') ORDER BY CASE WHEN starts_with(lower(strip_accents(replace(replace(coalesce(name, ''), 'Ø', 'O'), 'ø', 'o'))), 'fj') THEN 0 ELSE 1 END, coverage DESC, org LIMIT 20")
def research_lookup(t) -> DataFrame:
    """The twenty best hits for part of a name (a top-k report)."""
    return directory.lookup(directory_table(t), "Fj", "name", "org", "coverage").select("org", "name", "coverage")


@query(DIRECTORY_SQL + "SELECT org, legal_form, employees, revenue FROM dir WHERE legal_form = 'AS' AND employees >= 5 ORDER BY revenue DESC NULLS LAST, org LIMIT 10")
def screen_topk(t) -> DataFrame:
    """The ten largest companies by revenue that meet two conditions (a top-k report)."""
    return directory.screen(directory_table(t), [("legal_form", "eq", "AS"), ("employees", ">=", 5)], ("revenue", "desc"), 10).select("org", "legal_form", "employees", "revenue")


@query(DIRECTORY_SQL + "SELECT org, website, industry FROM dir WHERE website <> '' AND contains(lower(industry), 'bygg')")
def screen_present(t) -> DataFrame:
    """Organisations with a site in an industry."""
    return directory.screen(directory_table(t), [("website", "present", None), ("industry", "contains", "Bygg")]).select("org", "website", "industry")


@query("""
SELECT field, max(CASE WHEN c_custkey = 1 THEN value END) AS "1", max(CASE WHEN c_custkey = 2 THEN value END) AS "2", max(CASE WHEN c_custkey = 3 THEN value END) AS "3"
FROM (SELECT c_custkey, unnest(['c_name', 'c_mktsegment', 'c_nationkey']) AS field, unnest([c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR)]) AS value FROM customer WHERE c_custkey IN (1, 2, 3)) GROUP BY 1
""")
def compare_pivot(t) -> DataFrame:
    """Three chosen rows side by side."""
    return directory.compare(t("customer").withColumn("k", F.col("c_custkey").cast("string")), "k", ["1", "2", "3"], ["c_name", "c_mktsegment", "c_nationkey"])


@query(DIRECTORY_SQL + """SELECT org, name || ' is a ' || coalesce(CASE WHEN employees IS NULL THEN CASE WHEN revenue >= 500000000 THEN 'large' WHEN revenue >= 100000000 THEN 'medium-sized' WHEN revenue >= 20000000 THEN 'small' END
    WHEN employees >= 250 THEN 'large' WHEN employees >= 50 THEN 'medium-sized' WHEN employees >= 10 THEN 'small' WHEN employees >= 1 THEN 'micro' END || ' ', '') || 'company'
  || coalesce(' based in ' || municipality, '') || CASE WHEN jobs > 0 THEN ', hiring (' || jobs || CASE WHEN jobs = 1 THEN ' open ad)' ELSE ' open ads)' END ELSE '' END || '.' AS sentence FROM dir WHERE name IS NOT NULL""")
def summary_sentences(t) -> DataFrame:
    """One sentence for each organisation that has a name, sized by revenue where staff is unknown."""
    return sentences(directory_table(t).where("name is not null"))


def sentences(rows: DataFrame) -> DataFrame:
    """org and sentence of rows of the directory."""
    size = F.coalesce(F.concat(maths.size_word(F.col("employees"), F.col("revenue")), F.lit(" ")), F.lit(""))
    where = F.coalesce(F.concat(F.lit(" based in "), F.col("municipality")), F.lit(""))
    jobs = F.when(F.col("jobs") > 0, F.concat(F.lit(", hiring ("), X.count_of(F.col("jobs"), "open ad"), F.lit(")"))).otherwise("")
    return rows.select("org", F.concat(F.col("name"), F.lit(" is a "), size, F.lit("company"), where, jobs, F.lit(".")).alias("sentence"))


@query("""
WITH q AS (SELECT doc_id, lower(coalesce(text, '')) AS q FROM documents)
SELECT CASE WHEN contains(q, 'daglig leder') THEN 'leadership' WHEN contains(q, 'omsetning') OR contains(q, 'revenue') THEN 'financials' WHEN contains(q, 'søker') OR contains(q, 'looking for') THEN 'jobs'
  WHEN contains(q, 'adresse') OR contains(q, 'holder til') THEN 'locations' WHEN contains(q, 'åpner') OR contains(q, 'open') THEN 'hours' ELSE 'not found' END AS intent, count(*) AS documents FROM q GROUP BY 1
""")
def question_router(t) -> DataFrame:
    """The first intent whose keyword a text has."""
    q = F.lower(F.coalesce("text", F.lit("")))
    has = lambda *w: F.lit(False) if not w else (q.contains(w[0]) | has(*w[1:]))
    intent = (
        F.when(has("daglig leder"), "leadership").when(has("omsetning", "revenue"), "financials").when(has("søker", "looking for"), "jobs")
        .when(has("adresse", "holder til"), "locations").when(has("åpner", "open"), "hours").otherwise("not found")
    )
    return t("documents").groupBy(intent.alias("intent")).agg(F.count("*").alias("documents"))


SHELL_FORMS = ("BRL", "ESEK", "SAM")


@query(f"""
WITH {REGISTER}, x AS (SELECT org, b.antallAnsatte AS n, coalesce(b.hjemmeside, '') <> '' AS site, coalesce(b.konkurs, FALSE) AS bad FROM reg),
y AS (SELECT *, CASE WHEN n >= 50 THEN 'T3' WHEN n >= 5 THEN 'T2' WHEN n > 0 AND site THEN 'T2' WHEN n > 0 OR site THEN 'T1' ELSE 'T0' END AS tier FROM x)
SELECT org, CASE WHEN bad THEN CASE WHEN tier IN ('T0', 'T1') THEN 'T0' ELSE 'T1' END ELSE tier END AS tier FROM y
""")
def tier_classifier(t) -> DataFrame:
    """A tier for each organisation by staff and site."""
    n, site = F.col("body.antallAnsatte"), F.coalesce("body.hjemmeside", F.lit("")) != ""
    tier = F.when(n >= 50, "T3").when(n >= 5, "T2").when((n > 0) & site, "T2").when((n > 0) | site, "T1").otherwise("T0")
    bad = F.coalesce("body.konkurs", F.lit(False))
    return register(t).withColumn("tier", tier).select("org", F.when(bad, F.when(F.col("tier").isin("T0", "T1"), "T0").otherwise("T1")).otherwise(F.col("tier")).alias("tier"))


@query(f"""
WITH {REGISTER} SELECT org, b.registreringsdatoEnhetsregisteret AS founded,
  CAST(2026 - year(d) - CASE WHEN month(d) * 100 + day(d) > 930 THEN 1 ELSE 0 END AS INT) AS age FROM (SELECT org, b, try_cast(b.registreringsdatoEnhetsregisteret AS DATE) AS d FROM reg)
""")
def age_years(t) -> DataFrame:
    """Whole years since registration on a given day."""
    d = F.col("body.registreringsdatoEnhetsregisteret")
    return register(t).select("org", d.alias("founded"), dates.years_since(d, F.lit("2026-09-30")).alias("age"))
