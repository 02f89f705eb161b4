"""Queries of marks, values as text, sections, caps and bounded history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import marks, maths
from ..functions import text as X
from ..operators import choosing
from .catalog import Catalog, newest
from .claims_queries import SQL_ACCOUNTS, accounts

catalog = Catalog()
query = catalog.query


def sql_words(column: str, words) -> str:
    return f"coalesce(regexp_matches(lower({column}), '\\b(?:{'|'.join(words)})\\b'), FALSE)"


@query("""
WITH c AS (SELECT DISTINCT value FROM claims WHERE value IS NOT NULL), j AS (SELECT value, CAST(value AS JSON) AS j FROM c)
SELECT value, CASE WHEN json_type(j) = 'OBJECT' THEN CASE
    WHEN json_extract_string(j, '$.amount') IS NOT NULL THEN json_extract_string(j, '$.amount') || ' ' || coalesce(json_extract_string(j, '$.currency'), 'NOK')
    WHEN json_extract_string(j, '$.title') IS NOT NULL THEN concat_ws(' — ', json_extract_string(j, '$.title'), json_extract_string(j, '$.employer_name'), substr(coalesce(json_extract_string(j, '$.published'), json_extract_string(j, '$.application_due')), 1, 10))
    WHEN json_extract_string(j, '$.url') IS NOT NULL THEN json_extract_string(j, '$.url')
    WHEN json_extract_string(j, '$.role') IS NOT NULL THEN trim(json_extract_string(j, '$.role') || ': ' || coalesce(json_extract_string(j, '$.name'), ''))
    WHEN json_extract_string(j, '$.postcode') IS NOT NULL THEN concat_ws(', ', json_extract_string(j, '$.name'), json_extract_string(j, '$.postcode')) ELSE value END
  ELSE json_extract_string(j, '$') END AS text FROM j
""")
def value_text(t) -> DataFrame:
    """Claim values as the text that a reader finds."""
    return t("claims").select("value").where("value is not null").distinct().select("value", marks.value_text(F.col("value")).alias("text"))


@query("""
SELECT host, count(*) AS pages, CAST(count_if(len(regexp_extract_all(text, '©[ ]*[0-9]{4}[ ]*([^\\n]+)')) > 0) AS BIGINT) AS signed FROM page_fetch WHERE text IS NOT NULL AND host IS NOT NULL GROUP BY 1
""")
def copyright_pages(t) -> DataFrame:
    """Pages of each host that carry a copyright line."""
    signed = F.size(F.regexp_extract_all("text", F.lit(r"©[ ]*[0-9]{4}[ ]*([^\n]+)"), 1)) > 0
    return t("page_fetch").where("text is not null and host is not null").groupBy("host").agg(F.count("*").alias("pages"), F.count_if(signed).alias("signed"))


@query()
def copyright_owners(t) -> DataFrame:
    """Companies named as owners on pages, by host."""
    rows = t("page_fetch").where("text is not null and host is not null").select("host", F.explode(marks.copyright_owners(F.col("text"))).alias("owner"))
    return rows.groupBy("host").agg(F.countDistinct("owner").alias("owners"), F.count("*").alias("lines"))


@query(f"""
SELECT source, CAST(count_if({sql_words("text", marks.HIJACKED)}) AS BIGINT) AS hijacked, count(*) AS documents FROM documents WHERE source IS NOT NULL GROUP BY 1
""")
def hijacked_texts(t) -> DataFrame:
    """Texts with marks of a hijacked site, by source."""
    return t("documents").where("source is not null").groupBy("source").agg(F.count_if(marks.hijacked(F.col("text"))).alias("hijacked"), F.count("*").alias("documents"))


@query()
def usable_descriptions(t) -> DataFrame:
    """Description claims and how many read as one."""
    rows = t("claims").where("family = 'description' and value is not null")
    good = marks.usable_description(F.get_json_object("value", "$"))
    return rows.groupBy("snapshot_no").agg(F.count("*").alias("claims"), F.count_if(good).alias("usable"))


@query("""
WITH p AS (SELECT organisation_number AS org, json_extract_string(value, '$.platform') AS platform, json_extract_string(value, '$.url') AS url FROM claims WHERE family = 'profiles' AND value IS NOT NULL AND snapshot_no = (SELECT max(snapshot_no) FROM claims)),
n AS (SELECT org, platform, count(DISTINCT url) AS accounts FROM p WHERE platform IS NOT NULL AND url IS NOT NULL GROUP BY 1, 2)
SELECT org, platform, accounts FROM n WHERE accounts <= 2
""")
def profile_cap(t) -> DataFrame:
    """Platforms of each organisation with at most two accounts; more are another's list."""
    p = newest(t("claims")).where("family = 'profiles' and value is not null").select(F.col("organisation_number").alias("org"), F.get_json_object("value", "$.platform").alias("platform"), F.get_json_object("value", "$.url").alias("url"))
    return p.where("platform is not null and url is not null").groupBy("org", "platform").agg(F.count_distinct("url").alias("accounts")).where("accounts <= 2")


SECTIONS = {"who": ("identity", "leadership", "group"), "money": ("financials", "financial_history"), "presence": ("website", "profiles", "description"), "activity": ("activity", "jobs", "reviews"), "places": ("locations",)}


@query(
    "SELECT organisation_number AS org, CASE "
    + " ".join(f"WHEN family IN ({', '.join(repr(f) for f in fs)}) THEN '{s}'" for s, fs in SECTIONS.items())
    + " END AS section, count(DISTINCT claim_id) AS claims, sha256(string_agg(DISTINCT claim_id, ',' ORDER BY claim_id)) AS ids FROM claims WHERE snapshot_no = (SELECT max(snapshot_no) FROM claims) AND claim_id IS NOT NULL AND status = 'current' GROUP BY 1, 2"
)
def claim_sections(t) -> DataFrame:
    """Claims of each section of an organisation's profile, with a digest of their sorted ids."""
    section = F.lit(None).cast("string")
    for s, fs in SECTIONS.items():
        section = F.when(F.col("family").isin(*fs), s).otherwise(section)
    rows = newest(t("claims")).where("claim_id is not null and status = 'current'").select(F.col("organisation_number").alias("org"), section.alias("section"), "claim_id").distinct()
    return rows.groupBy("org", "section").agg(F.count("*").alias("claims"), F.sha2(F.array_join(F.array_sort(F.collect_list("claim_id")), ","), 256).alias("ids"))


@query("""
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT user_id, event_id, n AS age FROM r WHERE n <= 20
""")
def bounded_history(t) -> DataFrame:
    """The last twenty entries of each key's log."""
    rows = choosing.top(t("events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 20)
    return rows.select("user_id", "event_id", F.col("rank").cast("long").alias("age"))


@query(f"""
WITH {SQL_ACCOUNTS}, y AS (SELECT org, substr(x.regnskapsperiode.tilDato, 1, 4) AS year, max(x.resultatregnskapResultat.driftsresultat.driftsinntekter.sumDriftsinntekter) AS v FROM a WHERE x.regnskapstype = 'SELSKAP' GROUP BY 1, 2),
s AS (SELECT org, year, v, lag(v) OVER w AS pv, lag(year) OVER w AS py, row_number() OVER (PARTITION BY org ORDER BY year DESC) AS n FROM y WHERE v IS NOT NULL AND year IS NOT NULL WINDOW w AS (PARTITION BY org ORDER BY year)),
c AS (SELECT *, round((v - pv) / abs(pv) * 100, 6) AS pct FROM s WHERE n = 1 AND pv IS NOT NULL AND pv <> 0)
SELECT org, 'Revenue ' || CASE WHEN pct > 0.5 THEN 'rose' WHEN pct < -0.5 THEN 'fell' ELSE 'was flat' END || ' from ' || py || ' to ' || year || '.' AS sentence FROM c
""")
def revenue_trend(t) -> DataFrame:
    """One sentence on the last change of revenue."""
    y = accounts(t).where("x.regnskapstype = 'SELSKAP'").groupBy("org", F.substring("x.regnskapsperiode.tilDato", 1, 4).alias("year")).agg(F.max("x.resultatregnskapResultat.driftsresultat.driftsinntekter.sumDriftsinntekter").alias("v"))
    w = W.partitionBy("org").orderBy("year")
    s = y.where("v is not null and year is not null").withColumns({"pv": F.lag("v").over(w), "py": F.lag("year").over(w), "n": F.row_number().over(W.partitionBy("org").orderBy(F.desc("year")))})
    s = s.where("n = 1 and pv is not null and pv <> 0").withColumn("pct", F.round(maths.pct_change(F.col("pv"), F.col("v")), 6))
    move = F.when(F.col("pct") > 0.5, "rose").when(F.col("pct") < -0.5, "fell").otherwise("was flat")
    return s.select("org", F.concat(F.lit("Revenue "), move, F.lit(" from "), F.col("py"), F.lit(" to "), F.col("year"), F.lit(".")).alias("sentence"))


@query("""
WITH n AS (SELECT p_partkey, p_type, p_size, CASE WHEN contains(upper(p_name), 'COLD') THEN 'franchise_like_name' WHEN p_type = 'ECONOMY' THEN 'asa' WHEN p_size >= 30 AND p_brand = 'Brand#1' THEN 'staffed' ELSE '' END AS bucket FROM part)
SELECT bucket, count(*) AS parts FROM n GROUP BY 1
""")
def stress_buckets(t) -> DataFrame:
    """Rows by the first criterion that they meet."""
    bucket = F.when(F.upper("p_name").contains("COLD"), "franchise_like_name").when(F.col("p_type") == "ECONOMY", "asa").when((F.col("p_size") >= 30) & (F.col("p_brand") == "Brand#1"), "staffed").otherwise("")
    return t("part").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("parts"))


@query("""
WITH s AS (SELECT DISTINCT employer_orgnr AS org, regexp_replace(employer_parent, '\\D', '', 'g') AS parent FROM active_ads WHERE employer_orgnr IS NOT NULL), k AS (SELECT org AS k, org FROM s UNION SELECT parent, org FROM s WHERE parent IS NOT NULL)
SELECT k AS organisation, count(DISTINCT org) AS members FROM k GROUP BY 1
""")
def subunit_keys(t) -> DataFrame:
    """Numbers under which an organisation's ads may stand: its own and its members'."""
    s = t("active_ads").where("employer_orgnr is not null").select(F.col("employer_orgnr").alias("org"), X.digits(F.col("employer_parent")).alias("parent")).distinct()
    k = s.select(F.col("org").alias("organisation"), "org").unionByName(s.where("parent is not null").select(F.col("parent").alias("organisation"), "org"))
    return k.groupBy("organisation").agg(F.count_distinct("org").alias("members"))
