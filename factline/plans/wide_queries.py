"""Queries of claims from the register's bodies, websites, texts, scores, screens and profiles, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import marks, workforce
from ..functions import text as X
from ..operators import scoring, sites
from .catalog import SQL_NEWEST, Catalog, newest

catalog = Catalog()
query = catalog.query

SQL_HOST = "regexp_replace(split_part(split_part(split_part(regexp_replace(lower(trim({0})), '^[a-z]+://', ''), '/', 1), '?', 1), '#', 1), '^www[.]', '')"
SQL_LAST = """l AS (SELECT body.organisasjonsnummer AS org, arg_max(body, {'s': snapshot_date, 'r': retrieved_at}) AS b FROM register_entity WHERE status = 200 AND body.organisasjonsnummer IS NOT NULL GROUP BY 1)"""


def host(url: Column) -> Column:
    """The host of an address, in small letters without www; null for null."""
    bare = F.regexp_replace(F.lower(F.trim(url)), "^[a-z]+://", "")
    return F.regexp_replace(F.regexp_extract(bare, "^([^/?#]*)", 1), r"^www\.", "")


def entities(t) -> DataFrame:
    """org and b, the body of each organisation's latest snapshot and fetch."""
    rows = t("register_entity").where("status = 200 and body.organisasjonsnummer is not null")
    return rows.groupBy(F.col("body.organisasjonsnummer").alias("org")).agg(F.max_by("body", F.struct("snapshot_date", "retrieved_at")).alias("b"))


IDENTITY = {
    "legal_name": ("b.navn", "b.navn"), "legal_form": ("b.organisasjonsform.kode", "b.organisasjonsform.kode"), "postcode": ("b.postadresse.postnummer", "b.postadresse.postnummer"),
    "city": ("b.postadresse.poststed", "b.postadresse.poststed"), "municipality": ("b.postadresse.kommune", "b.postadresse.kommune"), "country": ("b.postadresse.landkode", "b.postadresse.landkode"),
    "registered": ("b.registreringsdatoEnhetsregisteret", "b.registreringsdatoEnhetsregisteret"), "industry": ("b.naeringskode1.kode", "b.naeringskode1.kode"), "industry_label": ("b.naeringskode1.beskrivelse", "b.naeringskode1.beskrivelse"),
    "employees": ("cast(b.antallAnsatte as string)", "CAST(b.antallAnsatte AS VARCHAR)"), "website": ("b.hjemmeside", "b.hjemmeside"), "vat": ("cast(b.registrertIMvaregisteret as string)", "CAST(b.registrertIMvaregisteret AS VARCHAR)"),
    "bankrupt": ("cast(b.konkurs as string)", "CAST(b.konkurs AS VARCHAR)"), "former_names": ("cast(nullif(size(b.historiskeNavn), 0) as string)", "CAST(nullif(len(b.historiskeNavn), 0) AS VARCHAR)"),
}


@query(f"WITH {SQL_LAST} " + " UNION ALL ".join(f"SELECT org, '{f}' AS field, {sql} AS value FROM l WHERE {sql} IS NOT NULL" for f, (_, sql) in IDENTITY.items()))
def claims_identity(t) -> DataFrame:
    """The fields of each organisation's latest body as rows, without those that are null."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.expr(e).alias("value")) for f, (e, _) in IDENTITY.items()])
    return entities(t).select("org", F.explode(fields).alias("x")).select("org", "x.field", "x.value").where("value is not null")


@query(f"WITH {SQL_LAST} SELECT org, b.naeringskode1.beskrivelse AS activity FROM l WHERE length(trim(b.naeringskode1.beskrivelse)) >= 12")
def registered_activity(t) -> DataFrame:
    """What each organisation is registered to do, where that is said in twelve letters or more."""
    return entities(t).select("org", F.col("b.naeringskode1.beskrivelse").alias("activity")).where(F.length(F.trim("activity")) >= 12)


@query(f"WITH {SQL_LAST}, a AS (SELECT org, b.postadresse AS p, unnest(b.postadresse.adresse) AS line, generate_subscripts(b.postadresse.adresse, 1) - 1 AS place FROM l) SELECT org, CAST(place AS INT) AS place, line, p.postnummer AS postcode, p.poststed AS city FROM a WHERE line IS NOT NULL AND trim(line) <> ''")
def claims_addresses(t) -> DataFrame:
    """The lines of each organisation's address with their places."""
    rows = entities(t).select("org", F.col("b.postadresse").alias("p"), F.posexplode("b.postadresse.adresse").alias("place", "line"))
    return rows.where("line is not null and trim(line) <> ''").select("org", "place", "line", F.col("p.postnummer").alias("postcode"), F.col("p.poststed").alias("city"))


SQL_LINKS = """r AS (SELECT organisation_number AS org, arg_max(body, retrieved_at) AS b FROM register_roles WHERE status = 200 AND body IS NOT NULL AND organisation_number IS NOT NULL GROUP BY 1),
g AS (SELECT org, unnest(b.rollegrupper) AS g FROM r), x AS (SELECT org, unnest(g.roller) AS x FROM g), k AS (SELECT DISTINCT org, x.enhet.organisasjonsnummer AS other, x.type.kode AS role FROM x WHERE x.enhet.organisasjonsnummer IS NOT NULL)"""


def linked(t) -> DataFrame:
    """org, other, role: organisations that hold roles in others."""
    r = t("register_roles").where("status = 200 and body is not null and organisation_number is not null").groupBy(F.col("organisation_number").alias("org")).agg(F.max_by("body", "retrieved_at").alias("b"))
    x = r.select("org", F.explode("b.rollegrupper").alias("g")).select("org", F.explode("g.roller").alias("x"))
    return x.select("org", F.col("x.enhet.organisasjonsnummer").alias("other"), F.col("x.type.kode").alias("role")).where("other is not null").distinct()


@query(f"WITH {SQL_LINKS} SELECT org, other, role FROM k")
def group_links(t) -> DataFrame:
    """Links between organisations by their roles."""
    return linked(t)


@query(f"WITH {SQL_LAST}, {SQL_LINKS}, n AS (SELECT org, count(DISTINCT other) AS links FROM k GROUP BY 1), w AS (SELECT employer_orgnr AS org, count(DISTINCT uuid) AS ads, count(DISTINCT {SQL_HOST.format('employer_homepage')}) AS hosts FROM active_ads WHERE employer_orgnr IS NOT NULL GROUP BY 1) SELECT org, b.navn AS name, b.postadresse.postnummer AS postcode, coalesce(links, 0) AS links, coalesce(ads, 0) AS ads, coalesce(hosts, 0) AS hosts FROM l LEFT JOIN n USING (org) LEFT JOIN w USING (org)")
def registry_facts(t) -> DataFrame:
    """What other stages ask of an organisation, in one row: name, postcode, links, ads and their hosts."""
    n = linked(t).groupBy("org").agg(F.count_distinct("other").alias("links"))
    w = t("active_ads").where("employer_orgnr is not null").groupBy(F.col("employer_orgnr").alias("org")).agg(F.count_distinct("uuid").alias("ads"), F.count_distinct(host(F.col("employer_homepage"))).alias("hosts"))
    out = entities(t).select("org", F.col("b.navn").alias("name"), F.col("b.postadresse.postnummer").alias("postcode")).join(n, "org", "left").join(w, "org", "left")
    return out.na.fill(0, ["links", "ads", "hosts"])


SQL_CANDIDATES = f"""{SQL_LAST}, s AS (
  SELECT org, {SQL_HOST.format("b.hjemmeside")} AS host, 0 AS rank, 'register' AS source FROM l UNION ALL SELECT employer_orgnr, {SQL_HOST.format("employer_homepage")}, 1, 'ad' FROM active_ads
  UNION ALL SELECT regexp_replace(orgnr, '[^0-9]', '', 'g'), {SQL_HOST.format("website")}, 2, 'map' FROM osm UNION ALL SELECT organisation_number, {SQL_HOST.format("host")}, 3, 'page' FROM page_fetch
), c AS (SELECT org, host, arg_min(source, rank) AS source, min(rank) AS rank FROM s WHERE org IS NOT NULL AND host IS NOT NULL AND host <> '' AND host NOT IN ({", ".join(repr(h) for h in sites.LISTINGS)}) GROUP BY 1, 2)"""


def site_candidates(t) -> DataFrame:
    own = lambda rows, org, url: rows.select(org.alias("org"), host(url).alias("host"))
    return sites.candidates([
        ("register", own(entities(t), F.col("org"), F.col("b.hjemmeside"))), ("ad", own(t("active_ads"), F.col("employer_orgnr"), F.col("employer_homepage"))),
        ("map", own(t("osm"), F.regexp_replace("orgnr", "[^0-9]", ""), F.col("website"))), ("page", own(t("page_fetch"), F.col("organisation_number"), F.col("host"))),
    ])


@query(f"WITH {SQL_CANDIDATES} SELECT org, host, source, rank FROM c")
def website_candidates(t) -> DataFrame:
    """Websites that an organisation may have, each with the first source that names it, without listings."""
    return site_candidates(t)


@query(f"WITH {SQL_CANDIDATES}, w AS (SELECT org, count(*) AS hosts, min(host) AS first_host FROM c GROUP BY 1) SELECT org, hosts, CASE WHEN hosts = 1 THEN 'exact' ELSE 'ambiguous' END AS state FROM w UNION ALL SELECT l.org, 0, 'none' FROM l ANTI JOIN w USING (org)")
def website_states(t) -> DataFrame:
    """Whether an organisation has one website, several or none."""
    known = site_candidates(t).select("org", "host").unionByName(entities(t).select("org", F.lit(None).cast("string").alias("host")))
    hosts = known.groupBy("org").agg(F.collect_set("host").alias("h"))
    return hosts.select("org", F.size("h").cast("long").alias("hosts"), sites.site_state(F.col("h")).alias("state"))


@query(f"WITH {SQL_CANDIDATES}, r AS (SELECT org, host, row_number() OVER (PARTITION BY org ORDER BY rank, host) AS n FROM c WHERE NOT regexp_matches(host, '([.]kommune[.]no|[.]gov)$')) SELECT org, host, n AS place FROM r WHERE n <= 3")
def result_domains(t) -> DataFrame:
    """The first three hosts of each organisation, public bodies left out."""
    rows = site_candidates(t).where(~F.col("host").rlike(r"(\.kommune\.no|\.gov)$"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("org").orderBy("rank", "host")).cast("long")).where("place <= 3").select("org", "host", "place")


@query(f"SELECT host, CASE WHEN host IN ({', '.join(repr(h) for h in sites.CHAINS)}) THEN 'chain' WHEN host IN ({', '.join(repr(h) for h in sites.LISTINGS)}) THEN 'listing' ELSE 'own' END AS kind, count(*) AS pages FROM (SELECT {SQL_HOST.format('host')} AS host FROM page_fetch WHERE host IS NOT NULL) GROUP BY 1, 2")
def host_kinds(t) -> DataFrame:
    """Whether a host is a chain's, a listing or may be somebody's own."""
    h = F.col("host")
    kind = F.when(sites.listed(h, sites.CHAINS), "chain").when(sites.listed(h), "listing").otherwise("own")
    return t("page_fetch").where("host is not null").select(host(h).alias("host")).groupBy("host", kind.alias("kind")).agg(F.count("*").alias("pages"))


ABOUT_OTHERS = r"(kontakt|contact|personvern|privacy|ledige-?stillinger|jobb|careers|vilkar|terms|cookies?)"


@query(f"SELECT page_id, regexp_matches(lower(url), '/[^/]*{ABOUT_OTHERS}') OR coalesce(page_kind IN ('contact', 'privacy', 'jobs', 'terms'), FALSE) AS excluded FROM page_fetch WHERE url IS NOT NULL")
def page_kind_exclusion(t) -> DataFrame:
    """Pages that aren't about the company itself: contact, privacy, jobs, terms."""
    kind = F.coalesce(F.col("page_kind").isin("contact", "privacy", "jobs", "terms"), F.lit(False))
    return t("page_fetch").where("url is not null").select("page_id", (F.lower("url").rlike(f"/[^/]*{ABOUT_OTHERS}") | kind).alias("excluded"))


@query("WITH f AS (SELECT body.organisasjonsnummer AS org, min(substr(body.registreringsdatoEnhetsregisteret, 1, 10)) AS founded FROM register_entity WHERE status = 200 AND regexp_matches(body.registreringsdatoEnhetsregisteret, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') GROUP BY 1) SELECT doc_id, founded, CAST(retrieved_at AS DATE) < CAST(founded AS DATE) AS too_old FROM documents JOIN f ON organisation_number = org WHERE retrieved_at IS NOT NULL AND source = 'news'")
def articles_before_founding(t) -> DataFrame:
    """News of organisations, and whether they are older than their organisation, by the least of its dates."""
    e = t("register_entity").where(F.col("body.registreringsdatoEnhetsregisteret").rlike(r"^\d{4}-\d{2}-\d{2}") & (F.col("status") == 200))
    f = e.groupBy(F.col("body.organisasjonsnummer").alias("organisation_number")).agg(F.min(F.substring("body.registreringsdatoEnhetsregisteret", 1, 10)).alias("founded"))
    d = t("documents").where("retrieved_at is not null and source = 'news'").join(f, "organisation_number")
    return d.select("doc_id", "founded", (F.to_date("retrieved_at") < F.to_date("founded")).alias("too_old"))


@query(f"WITH x AS (SELECT page_id, host, unnest(links) AS link FROM page_fetch WHERE links IS NOT NULL) SELECT page_id, count(DISTINCT link) AS links, count(DISTINCT CASE WHEN {SQL_HOST.format('link')} = {SQL_HOST.format('host')} THEN link END) AS own, count(DISTINCT CASE WHEN regexp_matches(link, '^[a-z]+://[^/]+/[^/?#]+/[^/?#]+') THEN link END) AS deep FROM x WHERE link IS NOT NULL GROUP BY 1")
def listing_links(t) -> DataFrame:
    """Links of a page: all, those of its own host, and those that lead deep enough to be articles."""
    x = t("page_fetch").where("links is not null").select("page_id", "host", F.explode("links").alias("link")).where("link is not null")
    own = F.when(host(F.col("link")) == host(F.col("host")), F.col("link"))
    deep = F.when(F.col("link").rlike("^[a-z]+://[^/]+/[^/?#]+/[^/?#]+"), F.col("link"))
    return x.groupBy("page_id").agg(F.count_distinct("link").alias("links"), F.count_distinct(own).alias("own"), F.count_distinct(deep).alias("deep"))


@query(f"WITH {SQL_LAST}, n AS (SELECT org, split_part(lower(b.navn), ' ', 1) AS word FROM l WHERE b.navn IS NOT NULL), p AS (SELECT organisation_number AS org, host, text, title FROM page_fetch WHERE organisation_number IS NOT NULL AND host IS NOT NULL) SELECT org, host, count(*) AS pages, NOT bool_or(coalesce(contains(lower(text), word), FALSE) OR coalesce(contains(lower(title), word), FALSE)) AS lacks FROM p JOIN n USING (org) WHERE word <> '' GROUP BY 1, 2")
def site_lacks_name(t) -> DataFrame:
    """Whether no page that was read of a site names its organisation by the first word of its name."""
    n = entities(t).where("b.navn is not null").select("org", F.split_part(F.lower("b.navn"), F.lit(" "), F.lit(1)).alias("word")).where("word <> ''")
    p = t("page_fetch").where("organisation_number is not null and host is not null").select(F.col("organisation_number").alias("org"), "host", "text", "title").join(n, "org")
    names = F.coalesce(F.lower("text").contains(F.col("word")), F.lit(False)) | F.coalesce(F.lower("title").contains(F.col("word")), F.lit(False))
    return p.groupBy("org", "host").agg(F.count("*").alias("pages"), (~F.max(names)).alias("lacks"))


@query()
def workforce_texts(t) -> DataFrame:
    """How many people each text says are employed, by the first pattern that is found."""
    return t("documents").where("text is not null").select("doc_id", workforce.workforce(F.col("text")).alias("w")).where("w.status <> 'unknown'").select("doc_id", "w.status", "w.measure", "w.count")


@query(f"WITH {SQL_LAST}, o AS (SELECT osm_id, regexp_replace(orgnr, '[^0-9]', '', 'g') AS org FROM osm WHERE osm_id IS NOT NULL) SELECT DISTINCT osm_id, org, b.navn AS name FROM o LEFT JOIN l USING (org) WHERE length(org) = 9")
def knowledge_by_number(t) -> DataFrame:
    """Map features with the organisation of their number, however it is written; unknown numbers have no name."""
    o = t("osm").where("osm_id is not null").select("osm_id", F.regexp_replace("orgnr", "[^0-9]", "").alias("org")).where("length(org) = 9").distinct()
    return o.join(entities(t).select("org", F.col("b.navn").alias("name")), "org", "left").select("osm_id", "org", "name").distinct()


@query(f"WITH {SQL_LAST}, e AS (SELECT org, b.navn AS employer FROM l WHERE NOT coalesce(b.konkurs, FALSE)), a AS (SELECT DISTINCT uuid, employer_orgnr AS org, regexp_replace(employer_parent, '[^0-9]', '', 'g') AS parent FROM active_ads WHERE uuid IS NOT NULL) SELECT uuid, a.org, employer, p.b.navn AS parent_name FROM a JOIN e ON a.org = e.org LEFT JOIN l p ON a.parent = p.org")
def ads_enriched(t) -> DataFrame:
    """Ads of employers that aren't bankrupt, with the names of employer and parent."""
    names = entities(t).select("org", F.col("b.navn").alias("name"), F.coalesce("b.konkurs", F.lit(False)).alias("gone"))
    a = t("active_ads").where("uuid is not null").select("uuid", F.col("employer_orgnr").alias("org"), F.regexp_replace("employer_parent", "[^0-9]", "").alias("parent")).distinct()
    with_employer = a.join(names.where("not gone").select("org", F.col("name").alias("employer")), "org")
    return with_employer.join(names.select(F.col("org").alias("parent"), F.col("name").alias("parent_name")), "parent", "left").select("uuid", "org", "employer", "parent_name")


@query(f"WITH {SQL_LINKS}, a AS (SELECT DISTINCT employer_orgnr AS org, regexp_replace(employer_parent, '[^0-9]', '', 'g') AS parent FROM active_ads WHERE employer_orgnr IS NOT NULL AND employer_parent IS NOT NULL), l AS (SELECT DISTINCT org, other FROM k) SELECT a.org, a.parent, l.other IS NOT NULL AS confirmed FROM a LEFT JOIN l ON a.org = l.org AND a.parent = l.other")
def parents_confirmed(t) -> DataFrame:
    """Parents that ads name, and whether the register of roles links the two."""
    a = t("active_ads").where("employer_orgnr is not null and employer_parent is not null").select(F.col("employer_orgnr").alias("org"), F.regexp_replace("employer_parent", "[^0-9]", "").alias("parent")).distinct()
    k = linked(t).select("org", F.col("other").alias("parent"), F.lit(True).alias("c")).distinct()
    return a.join(k, ["org", "parent"], "left").select("org", "parent", F.col("c").isNotNull().alias("confirmed"))


@query(f"WITH p AS (SELECT organisation_number AS org, count(DISTINCT json_extract_string(value, '$.title')) AS ours FROM claims WHERE field = 'job_posting' AND snapshot_no = {SQL_NEWEST} AND status = 'current' GROUP BY 1), g AS (SELECT employer_orgnr AS org, count(DISTINCT title) AS theirs FROM active_ads WHERE employer_orgnr IS NOT NULL GROUP BY 1) SELECT count(*) AS organisations, CAST(count_if((coalesce(ours, 0) > 0) = (coalesce(theirs, 0) > 0)) AS BIGINT) AS agree, CAST(count_if(coalesce(ours, 0) > 0 AND coalesce(theirs, 0) > 0) AS BIGINT) AS hit, CAST(count_if(coalesce(theirs, 0) > 0) AS BIGINT) AS wanted FROM p FULL OUTER JOIN g USING (org)")
def jobs_accuracy(t) -> DataFrame:
    """Organisations whose claims and ads agree on whether they hire, and the recall of hiring."""
    p = newest(t("claims")).where("field = 'job_posting' and status = 'current'").groupBy(F.col("organisation_number").alias("org")).agg(F.count_distinct(F.get_json_object("value", "$.title")).alias("ours"))
    g = t("active_ads").where("employer_orgnr is not null").groupBy(F.col("employer_orgnr").alias("org")).agg(F.count_distinct("title").alias("theirs"))
    both = p.join(g, "org", "full_outer").na.fill(0, ["ours", "theirs"])
    a, b = F.col("ours") > 0, F.col("theirs") > 0
    return both.agg(F.count("*").alias("organisations"), F.count_if(a == b).alias("agree"), F.count_if(a & b).alias("hit"), F.count_if(b).alias("wanted"))


@query("SELECT coalesce(page_kind, 'none') AS kind, count(*) AS fetches, round_even(count(*) * 0.0012, 4) AS cost FROM page_fetch GROUP BY 1")
def third_party_cost(t) -> DataFrame:
    """What fetches cost at a price for each, by kind of page."""
    return t("page_fetch").groupBy(F.coalesce("page_kind", F.lit("none")).alias("kind")).agg(F.count("*").alias("fetches"), F.bround(F.count("*") * F.lit(0.0012), 4).alias("cost"))


@query(f"WITH {SQL_LAST} SELECT coalesce(b.organisasjonsform.kode, 'none') AS form, count(*) AS organisations, min(org) AS first_org, max(org) AS last_org FROM l GROUP BY 1")
def universe_metadata(t) -> DataFrame:
    """Organisations by legal form, with the range of their numbers."""
    return entities(t).groupBy(F.coalesce("b.organisasjonsform.kode", F.lit("none")).alias("form")).agg(F.count("*").alias("organisations"), F.min("org").alias("first_org"), F.max("org").alias("last_org"))


@query("SELECT snapshot_no, count(*) AS claims, CAST(count_if(coalesce(len(evidence_ids), 0) > 0) AS BIGINT) AS cited, round_even(count_if(coalesce(len(evidence_ids), 0) > 0) / count(*), 4) AS citation_rate FROM claims WHERE value IS NOT NULL AND snapshot_no IS NOT NULL GROUP BY 1")
def citation_rates(t) -> DataFrame:
    """Of the claims with a value, how many name evidence, by snapshot."""
    cited = F.count_if(F.coalesce(F.size("evidence_ids"), F.lit(0)) > 0)
    return t("claims").where("value is not null and snapshot_no is not null").groupBy("snapshot_no").agg(F.count("*").alias("claims"), cited.alias("cited"), scoring.rate(cited, F.count("*")).alias("citation_rate"))


SQL_RATES = """r AS (SELECT snapshot_no AS s, count_if(availability = 'available') / count(*) AS a, count_if(coalesce(len(evidence_ids), 0) > 0) / count(*) AS c, count(*) - count(DISTINCT (organisation_number, claim_id)) = 0 AS uniq FROM claims WHERE snapshot_no IS NOT NULL GROUP BY 1)"""


@query(f"WITH {SQL_RATES} SELECT s AS snapshot_no, uniq AS gate, round_even(CASE WHEN uniq THEN round_even(a, 4) * 60 + round_even(c, 4) * 40 ELSE least(round_even(a, 4) * 60 + round_even(c, 4) * 40, 40.0) END, 2) AS points FROM r")
def proxy_total(t) -> DataFrame:
    """Points of each snapshot for availability and citation, at most 40 if any claim is there twice."""
    n = F.count("*")
    keys = F.count_distinct(F.struct("organisation_number", "claim_id"))
    r = t("claims").where("snapshot_no is not null").groupBy("snapshot_no").agg(scoring.rate(F.count_if(F.col("availability") == "available"), n).alias("a"), scoring.rate(F.count_if(F.coalesce(F.size("evidence_ids"), F.lit(0)) > 0), n).alias("c"), (n == keys).alias("gate"))
    return r.select("snapshot_no", "gate", scoring.points([(F.col("a"), 60.0), (F.col("c"), 40.0)], [F.col("gate")]).alias("points"))


@query("WITH k AS (SELECT DISTINCT snapshot_no AS s, organisation_number AS org, family, field, coalesce(value_key, '') AS v FROM claims WHERE snapshot_no IS NOT NULL), o AS (SELECT s, lag(s) OVER (ORDER BY s) AS before FROM (SELECT DISTINCT s FROM k)) SELECT o.s AS snapshot_no, count(*) AS earlier, CAST(count_if(n.s IS NOT NULL) AS BIGINT) AS carried, round_even(count_if(n.s IS NOT NULL) / count(*), 4) AS carried_rate FROM o JOIN k b ON b.s = o.before LEFT JOIN k n ON n.s = o.s AND n.org IS NOT DISTINCT FROM b.org AND n.family IS NOT DISTINCT FROM b.family AND n.field IS NOT DISTINCT FROM b.field AND n.v = b.v GROUP BY 1")
def refresh_scores(t) -> DataFrame:
    """Of the claims of each snapshot's predecessor, how many it still holds."""
    k = t("claims").where("snapshot_no is not null").select(F.col("snapshot_no").alias("s"), F.xxhash64(F.col("organisation_number"), F.lit("|"), "family", F.lit("|"), "field", F.lit("|"), F.coalesce("value_key", F.lit(""))).alias("k")).distinct()
    order = k.select("s").distinct().select(F.col("s").alias("snapshot_no"), F.lag("s").over(W.orderBy("s")).alias("s")).where("s is not null")
    earlier = k.join(F.broadcast(order), "s").select("snapshot_no", "k")  # one row for each snapshot
    now = k.select(F.col("s").alias("snapshot_no"), "k", F.lit(1).alias("there"))
    held = F.count("there")
    return earlier.join(now, ["snapshot_no", "k"], "left").groupBy("snapshot_no").agg(F.count("*").alias("earlier"), held.alias("carried"), scoring.rate(held, F.count("*")).alias("carried_rate"))


@query("WITH c AS (SELECT DISTINCT organisation_number AS org, family, run_id, snapshot_no FROM claims WHERE organisation_number IS NOT NULL AND run_id IS NOT NULL), p AS (SELECT a.org, a.family, a.run_id, max(b.snapshot_no) AS previous FROM c a LEFT JOIN c b ON a.org = b.org AND a.family = b.family AND b.snapshot_no < a.snapshot_no AND b.run_id <> a.run_id GROUP BY 1, 2, 3) SELECT run_id, count(*) AS checks, CAST(count_if(previous IS NOT NULL) AS BIGINT) AS checked_before FROM p GROUP BY 1")
def previous_checks(t) -> DataFrame:
    """Checks of a run that an earlier run has made too; the same run resumed is no earlier one."""
    c = t("claims").where("organisation_number is not null and run_id is not null").select(F.col("organisation_number").alias("org"), "family", "run_id", "snapshot_no").distinct()
    first = W.partitionBy("org", "family").orderBy("snapshot_no").rangeBetween(W.unboundedPreceding, -1)
    seen = c.withColumn("runs", F.collect_set("run_id").over(first)).withColumn("before", F.size(F.array_remove("runs", F.col("run_id"))) > 0)
    each = seen.groupBy("org", "family", "run_id").agg(F.max("before").alias("before"))
    return each.groupBy("run_id").agg(F.count("*").alias("checks"), F.count_if("before").alias("checked_before"))


@query("WITH d AS (SELECT organisation_number AS org, field, reporting_period.end AS e, substr(reporting_period.end, 1, 4) AS year FROM claims WHERE reporting_period.end IS NOT NULL AND organisation_number IS NOT NULL), p AS (SELECT DISTINCT org, field, e, year FROM d) SELECT org, field, year, lag(year) OVER w AS previous_year, coalesce(e > lag(e) OVER w, FALSE) AS advanced FROM p WINDOW w AS (PARTITION BY org, field ORDER BY e)")
def period_advance(t) -> DataFrame:
    """Reporting periods of each field by their years, and whether they advance on the period before."""
    p = t("claims").where("reporting_period.end is not null and organisation_number is not null").select(F.col("organisation_number").alias("org"), "field", F.col("reporting_period.end").alias("e")).distinct()
    w = W.partitionBy("org", "field").orderBy("e")
    year = F.substring("e", 1, 4)
    return p.select("org", "field", year.alias("year"), F.lag(year).over(w).alias("previous_year"), F.coalesce(F.col("e") > F.lag("e").over(w), F.lit(False)).alias("advanced"))


@query(f"SELECT DISTINCT organisation_number AS org FROM claims WHERE family = 'financials' AND availability = 'available' AND status = 'current' AND snapshot_no = {SQL_NEWEST} AND organisation_number IS NOT NULL")
def screen_available(t) -> DataFrame:
    """Organisations whose accounts are available."""
    return newest(t("claims")).where("family = 'financials' and availability = 'available' and status = 'current' and organisation_number is not null").select(F.col("organisation_number").alias("org")).distinct()


@query(f"WITH g AS (SELECT organisation_number AS org, count(*) AS facts, list(DISTINCT field) AS f FROM claims WHERE status = 'current' AND value IS NOT NULL AND snapshot_no = {SQL_NEWEST} AND organisation_number IS NOT NULL GROUP BY 1) SELECT org, facts, facts >= 5 AND list_has_all(f, ['legal_name', 'employees']) AS answers FROM g")
def entity_question(t) -> DataFrame:
    """Whether an organisation has the facts and the fields that a question about it asks for."""
    g = newest(t("claims")).where("status = 'current' and value is not null and organisation_number is not null").groupBy(F.col("organisation_number").alias("org")).agg(F.count("*").alias("facts"), F.collect_set("field").alias("f"))
    return g.select("org", "facts", ((F.col("facts") >= 5) & F.array_contains("f", "legal_name") & F.array_contains("f", "employees")).alias("answers"))


@query(f"WITH v AS (SELECT organisation_number AS org, max(CAST(json_extract_string(value, '$.amount') AS DOUBLE)) AS v, max(CASE WHEN snapshot_no = {SQL_NEWEST} THEN CAST(json_extract_string(value, '$.amount') AS DOUBLE) END) AS w FROM claims WHERE field = 'revenue' AND value IS NOT NULL AND organisation_number IS NOT NULL GROUP BY 1), a AS (SELECT org, row_number() OVER (ORDER BY v DESC NULLS LAST, org) AS ra, row_number() OVER (ORDER BY w DESC NULLS LAST, org) AS rb FROM v) SELECT org, ra AS expected, CASE WHEN rb <= 10 THEN rb END AS got FROM a WHERE ra <= 10")
def golden_keys(t) -> DataFrame:
    """A screen's ten expected keys in order, and the places that the latest snapshot gives them."""
    amount = F.get_json_object("value", "$.amount").try_cast("double")
    last = t("claims").agg(F.max("snapshot_no")).scalar()
    v = t("claims").where("field = 'revenue' and value is not null and organisation_number is not null").groupBy(F.col("organisation_number").alias("org")).agg(F.max(amount).alias("v"), F.max(F.when(F.col("snapshot_no") == last, amount)).alias("w"))

    def top(by: str, name: str) -> DataFrame:
        ten = v.orderBy(F.desc_nulls_last(by), "org").limit(10)  # ten rows go into the window
        return ten.select("org", F.row_number().over(W.orderBy(F.desc_nulls_last(by), "org")).cast("long").alias(name))

    return top("v", "expected").join(top("w", "got"), "org", "left")


@query("WITH n AS (SELECT DISTINCT name FROM place WHERE name IS NOT NULL UNION SELECT DISTINCT name FROM osm WHERE name IS NOT NULL) SELECT name, CASE WHEN regexp_matches(lower(name), '\\bavd(eling)?\\b') THEN 'branch' WHEN regexp_matches(lower(name), '\\b(konsern|gruppen|group|holding)\\b') THEN 'group' WHEN regexp_matches(lower(name), '\\b(kjede|franchise|butikken)\\b') THEN 'brand' END AS relationship FROM n")
def name_relationships(t) -> DataFrame:
    """What names of places and map features say of their bearers."""
    n = t("place").select("name").unionByName(t("osm").select("name")).where("name is not null").distinct()
    return n.select("name", sites.relationship(F.col("name")).alias("relationship"))


@query("SELECT DISTINCT value, to_json({'amount': json_extract_string(value, '$.amount'), 'year': json_extract_string(value, '$.year')}) AS quote FROM claims WHERE family = 'financials' AND value IS NOT NULL")
def json_quote(t) -> DataFrame:
    """Some members of a value, written again."""
    g = lambda k: F.get_json_object("value", f"$.{k}").alias(k)
    return t("claims").where("family = 'financials' and value is not null").select("value", F.to_json(F.struct(g("amount"), g("year")), {"ignoreNullFields": "false"}).alias("quote")).distinct()


MAIL, PHONE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"\b[0-9]{2}( ?[0-9]{2}){3}\b"


@query(f"SELECT doc_id, regexp_replace(regexp_replace(text, '{MAIL}', '[mail]', 'g'), '{PHONE}', '[phone]', 'g') <> text AS redacted, length(regexp_replace(regexp_replace(text, '{MAIL}', '[mail]', 'g'), '{PHONE}', '[phone]', 'g')) AS length FROM documents WHERE text IS NOT NULL")
def contacts_redacted(t) -> DataFrame:
    """Texts without mail addresses and phone numbers: whether any was there, and the length of the rest."""
    clean = F.regexp_replace(F.regexp_replace("text", MAIL, "[mail]"), PHONE, "[phone]")
    return t("documents").where("text is not null").select("doc_id", (clean != F.col("text")).alias("redacted"), F.length(clean).cast("long").alias("length"))


@query("SELECT coalesce(error, 'none') AS error, count(*) AS pages, CAST(count_if(coalesce(contains(lower(html), 'wp-content'), FALSE)) AS BIGINT) AS wordpress, CAST(count_if(coalesce(regexp_matches(error, '(?i)timeout|http_error|temporar'), FALSE)) AS BIGINT) AS transient FROM page_fetch GROUP BY 1")
def fetch_errors(t) -> DataFrame:
    """Pages by their error: which are transient, and which were made by a known publishing system."""
    transient = F.coalesce(F.col("error").rlike("(?i)timeout|http_error|temporar"), F.lit(False))
    return t("page_fetch").groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count("*").alias("pages"), F.count_if(F.coalesce(F.lower("html").contains("wp-content"), F.lit(False))).alias("wordpress"), F.count_if(transient).alias("transient"))


SQL_FIELDS = f"""f AS (SELECT organisation_number AS org, field, max(value) AS v FROM claims WHERE status = 'current' AND availability = 'available' AND value IS NOT NULL AND snapshot_no = {SQL_NEWEST} AND organisation_number IS NOT NULL GROUP BY 1, 2)"""


@query(f"WITH {SQL_FIELDS} SELECT org, coalesce(max(v) FILTER (WHERE field = 'official_website'), max(v) FILTER (WHERE field = 'profile'), max(v) FILTER (WHERE field = 'legal_name')) AS value FROM f GROUP BY 1")
def first_available(t) -> DataFrame:
    """The first of several fields that an organisation has: its website, a profile, or its name."""
    f = newest(t("claims")).where("status = 'current' and availability = 'available' and value is not null and organisation_number is not null").groupBy(F.col("organisation_number").alias("org"), "field").agg(F.max("value").alias("v"))
    one = lambda name: F.max(F.when(F.col("field") == name, F.col("v")))
    return f.groupBy("org").agg(F.coalesce(one("official_website"), one("profile"), one("legal_name")).alias("value"))


@query(f"WITH {SQL_FIELDS}, c AS (SELECT organisation_number AS org, count(*) AS claims, count(DISTINCT family) AS families FROM claims WHERE snapshot_no = {SQL_NEWEST} AND organisation_number IS NOT NULL GROUP BY 1) SELECT c.org, claims, families, max(v) FILTER (WHERE field = 'legal_name') AS name, max(v) FILTER (WHERE field = 'employees') AS employees, max(json_extract_string(v, '$.amount')) FILTER (WHERE field = 'revenue') AS revenue FROM c LEFT JOIN f ON c.org = f.org GROUP BY 1, 2, 3")
def compact_profiles(t) -> DataFrame:
    """Quick facts of each organisation in one row."""
    rows = newest(t("claims")).where("organisation_number is not null").withColumnRenamed("organisation_number", "org")
    c = rows.groupBy("org").agg(F.count("*").alias("claims"), F.count_distinct("family").alias("families"))
    f = rows.where("status = 'current' and availability = 'available' and value is not null").groupBy("org", "field").agg(F.max("value").alias("v"))
    one = lambda name, v: F.max(F.when(F.col("field") == name, v))
    facts = f.groupBy("org").agg(one("legal_name", F.col("v")).alias("name"), one("employees", F.col("v")).alias("employees"), one("revenue", F.get_json_object("v", "$.amount")).alias("revenue"))
    return c.join(facts, "org", "left").select("org", "claims", "families", "name", "employees", "revenue")


@query("SELECT organisation_number AS org, snapshot_no, claim_id, CASE WHEN len(list_filter(evidence_ids, lambda e: NOT starts_with(e, 'e_0'))) > 0 THEN len(list_filter(evidence_ids, lambda e: NOT starts_with(e, 'e_0'))) ELSE len(evidence_ids) END AS kept FROM claims WHERE evidence_ids IS NOT NULL AND claim_id IS NOT NULL")
def evidence_kept(t) -> DataFrame:
    """Evidence of claims after a kind of it is dropped; all of it is kept if nothing else is left."""
    rest = F.filter("evidence_ids", lambda e: ~e.startswith("e_0"))
    return t("claims").where("evidence_ids is not null and claim_id is not null").select(F.col("organisation_number").alias("org"), "snapshot_no", "claim_id", F.when(F.size(rest) > 0, F.size(rest)).otherwise(F.size("evidence_ids")).cast("long").alias("kept"))


@query("WITH c AS (SELECT CAST(regexp_extract(key, '^slice-([0-9]+)$', 1) AS INT) AS slice, run_id, run_status FROM nav_feed_cursor WHERE regexp_matches(key, '^slice-[0-9]+$') AND run_id IS NOT NULL) SELECT slice, max(run_id) AS last_run, max(run_id) FILTER (WHERE run_status = 'success') AS last_success, coalesce(max(run_id) = max(run_id) FILTER (WHERE run_status = 'success'), FALSE) AS complete FROM c GROUP BY 1")
def feed_progress(t) -> DataFrame:
    """How far each slice of the feed has come; it is complete if its last run succeeded."""
    c = t("nav_feed_cursor").where(F.col("key").rlike("^slice-[0-9]+$") & F.col("run_id").isNotNull()).select(F.regexp_extract("key", "^slice-([0-9]+)$", 1).cast("int").alias("slice"), "run_id", "run_status")
    good = F.max(F.when(F.col("run_status") == "success", F.col("run_id")))
    return c.groupBy("slice").agg(F.max("run_id").alias("last_run"), good.alias("last_success"), F.coalesce(F.max("run_id") == good, F.lit(False)).alias("complete"))


@query("SELECT count(DISTINCT uuid) AS uuids, min(uuid) AS first_uuid, max(uuid) AS last_uuid FROM active_ads")
def key_range(t) -> DataFrame:
    """How many keys the ads have, and the ends of their order."""
    return t("active_ads").agg(F.count_distinct("uuid").alias("uuids"), F.min("uuid").alias("first_uuid"), F.max("uuid").alias("last_uuid"))


def _words(column: str, words) -> str:
    return f"coalesce(regexp_matches(lower({column}), '\\b(?:{'|'.join(words)})\\b'), FALSE)"


@query(f"SELECT doc_id, CASE WHEN {_words('text', marks.SPAM_STRONG)} THEN 2 WHEN {_words('text', marks.SPAM_WEAK)} THEN 1 ELSE 0 END AS spam FROM documents")
def spam_marks(t) -> DataFrame:
    """Texts with strong (2) or weak (1) marks of spam."""
    return t("documents").select("doc_id", marks.spam(F.col("text")).alias("spam"))


@query("SELECT page_id, CASE WHEN " + " OR ".join(f"contains(lower(text), '{m}')" for m in marks.PARKED) + " THEN 'parked' WHEN " + " OR ".join("contains(lower(text), '{}')".format(m.replace("'", "''")) for m in marks.SERVER_DEFAULT) + " THEN 'server default' WHEN length(text) <= 900 AND coalesce(len(links), 0) <= 3 AND (" + " OR ".join(f"contains(lower(text), '{m}')" for m in marks.COMING_SOON) + ") THEN 'coming soon' WHEN " + " OR ".join(f"contains(lower(text), '{m}')" for m in marks.DEAD) + " THEN 'dead' END AS state FROM page_fetch")
def page_states(t) -> DataFrame:
    """Pages that are parked, a server's default, coming soon or dead."""
    return t("page_fetch").select("page_id", marks.page_state(F.col("text"), F.when(F.col("links").isNotNull(), F.size("links"))).alias("state"))


@query()
def own_items(t) -> DataFrame:
    """Articles by whether they are their company's own publications."""
    return t("page_fetch").where("title is not null").select("page_id", marks.own_item(F.col("title"), F.col("url")).alias("own"))


@query()
def applicant_systems(t) -> DataFrame:
    """Applicant systems that pages link to."""
    return t("page_fetch").where("links is not null").select("page_id", marks.applicant_system(F.col("links")).alias("a")).where("a is not null").select("page_id", "a.provider", "a.url")


@query()
def phones_in_texts(t) -> DataFrame:
    """Phone numbers of texts, and how many texts have each."""
    return t("documents").where("text is not null").select(F.explode(X.find_phones(F.col("text"))).alias("phone")).groupBy("phone").agg(F.count("*").alias("texts"))
