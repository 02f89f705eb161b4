"""Queries of key lists, joins, choices of rows and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.instants import instant
from ..operators import choosing, matching, stats
from ..operators.skew import hot_join
from .catalog import Catalog

catalog = Catalog()
query = catalog.query

#: DuckDB counterparts of the normalisers.
SQL_FOLD = "regexp_replace(lower(strip_accents(replace(replace(replace(replace(replace(replace(coalesce({0}, ''), 'æ', 'ae'), 'Æ', 'AE'), 'ø', 'o'), 'Ø', 'O'), 'å', 'a'), 'Å', 'A'))), '[^\\x00-\\x7F]', '', 'g')"


def sql_words(column: str, drop: list[str]) -> str:
    stop = ", ".join(f"'{w}'" for w in drop)
    return f"array_to_string(list_filter(regexp_extract_all({SQL_FOLD.format(column)}, '[a-z0-9]+'), lambda t: t NOT IN ({stop})), ' ')"


SQL_SITE = "rtrim(regexp_replace(regexp_replace(lower(trim(coalesce({0}, ''))), '^https?://', ''), '^www\\.', ''), '/')"
SQL_HOST = "nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim(trim({0}), '.')), '^.*?//', ''), '[/?#].*$', ''), ':.*$', ''), '')"
SQL_MS = "epoch_ms(coalesce(try_cast({0} AS TIMESTAMPTZ), CASE WHEN regexp_full_match({0}, '-?[0-9]{{9,15}}') THEN to_timestamp(CAST({0} AS BIGINT) / 1000.0) END))"
REGISTER = """
r AS (
  SELECT body.organisasjonsnummer AS org, snapshot_date AS snap, arg_max(body, (retrieved_at, snapshot_date)) AS b FROM register_entity
  WHERE status = 200 AND body.organisasjonsnummer IS NOT NULL AND snapshot_date IS NOT NULL GROUP BY 1, 2
), reg AS (SELECT org, arg_max(b, snap) AS b FROM r GROUP BY 1)
"""


def register(t) -> DataFrame:
    """org and body of each organisation's latest snapshot."""
    rows = t("register_entity").where("status = 200 and body.organisasjonsnummer is not null and snapshot_date is not null")
    rows = rows.select(F.col("body.organisasjonsnummer").alias("org"), "snapshot_date", "retrieved_at", "body")
    return choosing.last_wins(rows, ["org"], F.col("snapshot_date"), F.col("retrieved_at")).select("org", "body")


@query("""
SELECT d AS organisation_number, min(osm_id) AS first_seen FROM (SELECT regexp_replace(orgnr, '\\D', '', 'g') AS d, osm_id FROM osm) WHERE length(d) = 9 GROUP BY 1
""")
def key_list_clean(t) -> DataFrame:
    """Digits of a list of keys, only those of nine, each once, with where it was first seen."""
    keys = t("osm").select(X.digits(F.col("orgnr")).alias("organisation_number"), "osm_id")
    return keys.where(F.length("organisation_number") == 9).groupBy("organisation_number").agg(F.min("osm_id").alias("first_seen"))


@query("""
SELECT snapshot_date, count(*) AS n FROM register_entity WHERE body.organisasjonsnummer IN (SELECT organisation_number FROM claims WHERE family = 'website') GROUP BY 1
""")
def bulk_semi_join(t) -> DataFrame:
    """Register rows of wanted organisations, counted by snapshot."""
    rows = t("register_entity").select("snapshot_date", F.col("body.organisasjonsnummer").alias("organisation_number"))
    return matching.wanted(rows, t("claims").where("family = 'website'"), "organisation_number").groupBy("snapshot_date").agg(F.count("*").alias("n"))


@query(f"""
WITH w AS (SELECT array_to_string(list_slice(string_split({SQL_HOST.format("employer_homepage")}, '.'), -2, -1), '.') AS d FROM active_ads WHERE employer_homepage IS NOT NULL),
o AS (SELECT array_to_string(list_slice(string_split({SQL_HOST.format("website")}, '.'), -2, -1), '.') AS d FROM osm WHERE website IS NOT NULL)
SELECT coalesce(a.d, b.d) AS domain, coalesce(a.n, 0) AS ad_count, coalesce(b.n, 0) AS map_count, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) >= 3 AS shared
FROM (SELECT d, count(*) AS n FROM w GROUP BY 1) a FULL OUTER JOIN (SELECT d, count(*) AS n FROM o GROUP BY 1) b ON a.d = b.d
""")
def domain_share_counts(t) -> DataFrame:
    """Rows for each domain in two tables, and whether three or more share it or it is a mail provider's."""
    a = t("active_ads").select(X.registered_domain(F.col("employer_homepage")).alias("a"), F.lit(None).cast("string").alias("o"))
    o = t("osm").select(F.lit(None).cast("string").alias("a"), X.registered_domain(F.col("website")).alias("o"))
    out = stats.counts_of(a.unionByName(o), {"ad_count": "a", "map_count": "o"}).withColumnRenamed("value", "domain")
    return out.withColumn("shared", (F.greatest("ad_count", "map_count") >= 3) | F.col("domain").isin(*X.FREEMAIL))


@query("""
SELECT n_name AS parent, c_name AS child, c_custkey AS child_key, count(*) OVER (PARTITION BY n_name) AS children FROM nation JOIN customer ON n_nationkey = c_nationkey
""")
def children_of_parents(t) -> DataFrame:
    """One row for each child, with its parent's number of children; no group is gathered in one task."""
    nations = t("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("parent"))
    children = hot_join(t("customer").select("c_nationkey", "c_custkey", "c_name"), nations, "c_nationkey")
    counts = children.groupBy("parent").agg(F.count("*").alias("children"))
    return hot_join(children, counts, "parent").select("parent", F.col("c_name").alias("child"), F.col("c_custkey").alias("child_key"), "children")


@query("""
SELECT core, min(id) AS first_id, arg_min(name, (id, coalesce(name, ''))) AS first_name, string_agg(DISTINCT postcode, ',' ORDER BY postcode) AS postcodes,
  max(postcode) FILTER (WHERE postcode IS NOT NULL) AS last_postcode
FROM place WHERE core IS NOT NULL GROUP BY 1
""")
def group_per_key(t) -> DataFrame:
    """First label, sorted distinct values and last value of each key, in one aggregation."""
    rows = t("place").where("core is not null")
    return rows.groupBy("core").agg(
        F.min("id").alias("first_id"), F.min_by("name", F.struct("id", F.coalesce("name", F.lit("")))).alias("first_name"),
        F.nullif(F.array_join(F.array_sort(F.collect_set("postcode")), ","), F.lit("")).alias("postcodes"), F.max("postcode").alias("last_postcode"),
    )


@query(f"""
WITH x AS (SELECT uuid, {SQL_MS.format("sistendret")} AS ms, status, retrieved_at FROM feed_entry WHERE uuid IS NOT NULL),
l AS (SELECT uuid, arg_max(coalesce(status, ''), (retrieved_at, coalesce(ms, 0), coalesce(status, ''))) AS status, max(retrieved_at) AS seen FROM x GROUP BY 1)
SELECT uuid, status, CAST(seen AS VARCHAR) AS seen FROM l WHERE status = 'ACTIVE'
""")
def event_log_compaction(t) -> DataFrame:
    """Last event of each uuid, without those that are no longer active."""
    log = t("feed_entry").where("uuid is not null").select("uuid", "status", F.coalesce(F.unix_millis(instant(F.col("sistendret"))), F.lit(0)).alias("ms"), "retrieved_at")
    state = choosing.compact(log, "uuid", [F.col("retrieved_at"), F.col("ms"), F.coalesce("status", F.lit(""))], "status", "ACTIVE")
    return state.select("uuid", "status", F.col("retrieved_at").cast("string").alias("seen"))


@query("""
WITH e AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, ts, event_id FROM events)
SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_status, arg_max(event_type, (ts, event_id)) AS last_status, CAST(count_if(prev IS NOT NULL AND prev <> event_type) AS BIGINT) AS flips, count(*) AS events
FROM e GROUP BY 1
""")
def event_status_ledger(t) -> DataFrame:
    """First and last status of each key, and how often it changed."""
    before = F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    rows, order = t("events").withColumn("prev", before), F.struct("ts", "event_id")
    return rows.groupBy("user_id").agg(
        F.min_by("event_type", order).alias("first_status"), F.max_by("event_type", order).alias("last_status"),
        F.count_if(F.col("prev").isNotNull() & (F.col("prev") != F.col("event_type"))).alias("flips"), F.count("*").alias("events"),
    )


@query("""
SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1
""")
def event_window_retention(t) -> DataFrame:
    """Events of the last seven days before the latest."""
    rows = t("events")
    last = rows.agg(F.max("ts")).first()[0]
    kept = rows.where(F.col("ts") >= F.lit(last) - F.expr("interval 7 days"))
    return kept.groupBy("event_type").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"))


@query(f"""
WITH {REGISTER}
SELECT reg.org, count(DISTINCT uuid) AS ads FROM reg JOIN active_ads ON employer_orgnr = reg.org OR employer_parent = reg.org GROUP BY 1
""")
def or_join_as_union(t) -> DataFrame:
    """Ads of an organisation by its own number or as a parent."""
    ads = t("active_ads").select("uuid", "employer_orgnr", "employer_parent")
    return matching.either_key(ads, ["employer_orgnr", "employer_parent"], register(t), "org", ["uuid"]).groupBy("org").agg(F.count("*").alias("ads"))


@query(f"""
WITH {REGISTER}, n AS (SELECT org, {sql_words("b.navn", X.LEGAL_TITLE)} AS norm FROM reg), a AS (SELECT DISTINCT uuid, {sql_words("business_name", X.LEGAL_TITLE)} AS norm FROM active_ads)
SELECT norm, count(DISTINCT org) AS organisations, count(DISTINCT uuid) AS ads FROM n JOIN a USING (norm) WHERE norm <> '' GROUP BY 1
""")
def normalised_name_join(t) -> DataFrame:
    """Ads and organisations with one normalised name."""
    orgs = register(t).select(X.norm_title(F.col("body.navn")).alias("norm"), "org")
    ads = t("active_ads").select(X.norm_title(F.col("business_name")).alias("norm"), "uuid")
    a = orgs.where("norm <> ''").groupBy("norm").agg(F.countDistinct("org").alias("organisations"))
    b = ads.where("norm <> ''").groupBy("norm").agg(F.countDistinct("uuid").alias("ads"))
    return a.join(b, "norm")


@query(f"""
WITH o AS (SELECT DISTINCT {sql_words("name", X.LEGAL_CORE)} AS a FROM osm), p AS (SELECT DISTINCT {sql_words("name", X.LEGAL_CORE)} AS b FROM place),
x AS (SELECT a, list_distinct(string_split(a, ' ')) AS ta FROM o WHERE a <> ''), y AS (SELECT b, list_distinct(string_split(b, ' ')) AS tb FROM p WHERE b <> '')
SELECT a, b, len(list_intersect(ta, tb)) / least(len(ta), len(tb)) AS overlap FROM x JOIN y ON len(list_intersect(ta, tb)) / least(len(ta), len(tb)) >= 0.6
""")
def token_overlap_join(t) -> DataFrame:
    """Names of map features and places that share 60 % of the words of the shorter."""
    a = t("osm").select(X.name_core(F.col("name")).alias("a")).where("a <> ''").distinct().withColumn("tokens", F.array_distinct(F.split("a", " ")))
    b = t("place").select(X.name_core(F.col("name")).alias("b")).where("b <> ''").distinct().withColumn("tokens", F.array_distinct(F.split("b", " ")))
    return matching.token_overlap(a, b)


@query(f"""
WITH o AS (SELECT DISTINCT osm_id, {SQL_SITE.format("website")} AS site, {sql_words("name", X.LEGAL_CORE)} AS core, coalesce(json_extract_string(socials, '$.facebook'), '') AS fb FROM osm WHERE osm_id IS NOT NULL),
p AS (SELECT DISTINCT id, {SQL_SITE.format("unnest(coalesce(nullif(from_json(websites, '[\"VARCHAR\"]'), []), [NULL]))")} AS site, {sql_words("name", X.LEGAL_CORE)} AS core, coalesce(json_extract_string(socials, '$.facebook'), '') AS fb FROM place WHERE id IS NOT NULL),
m AS (
  SELECT osm_id, id, 'site' AS how FROM o JOIN p USING (site) WHERE site <> '' UNION SELECT osm_id, id, 'core' FROM o JOIN p USING (core) WHERE core <> ''
  UNION SELECT osm_id, id, 'social' FROM o JOIN p USING (fb) WHERE fb <> ''
), g AS (SELECT osm_id, id, string_agg(how, '+' ORDER BY how) AS how, count(*) AS matches FROM m GROUP BY 1, 2)
SELECT osm_id, id, how, matches FROM (SELECT *, row_number() OVER (PARTITION BY osm_id ORDER BY matches DESC, id) AS r FROM g) WHERE r <= 4
""")
def multi_key_match(t) -> DataFrame:
    """Places of a map feature by site, name or social page: how they agree, the four best."""
    fb = F.coalesce(F.get_json_object("socials", "$.facebook"), F.lit(""))
    o = t("osm").where("osm_id is not null").select("osm_id", X.site_key(F.col("website")).alias("site"), X.name_core(F.col("name")).alias("core"), fb.alias("fb"))
    p = t("place").where("id is not null").select("id", F.explode_outer(F.from_json("websites", "array<string>")).alias("url"), X.name_core(F.col("name")).alias("core"), fb.alias("fb")).withColumn("site", X.site_key(F.col("url")))
    m = matching.several_keys(o, p, "osm_id", "id", {"site": ("site", "site"), "core": ("core", "core"), "social": ("fb", "fb")})
    best = choosing.top(m, ["osm_id"], [F.desc("matches"), F.col("id")], 4)
    return best.select("osm_id", "id", F.array_join("how", "+").alias("how"), "matches")


@query(f"""
WITH p AS (SELECT DISTINCT id, lpad(regexp_replace(postcode, '\\D', '', 'g'), 4, '0') AS pc, list_distinct(string_split({sql_words("name", X.LEGAL_CORE)}, ' ')) AS tk FROM place WHERE postcode IS NOT NULL AND id IS NOT NULL),
q AS (SELECT p.*, poststed, list_distinct(string_split({sql_words("poststed", X.LEGAL_CORE)}, ' ')) AS town FROM p JOIN (SELECT postnummer, min(poststed) AS poststed FROM postal_place GROUP BY 1) ON pc = postnummer)
SELECT pc AS postcode, count(DISTINCT id) AS places, count(DISTINCT CASE WHEN len(list_intersect(tk, town)) > 0 THEN id END) AS named_after_town FROM q GROUP BY 1
""")
def postcode_token_match(t) -> DataFrame:
    """Places joined to their postal town by code, and how many carry a word of its name."""
    tokens = lambda c: F.array_distinct(F.split(X.name_core(F.col(c)), " "))
    p = t("place").where("postcode is not null and id is not null").select("id", F.lpad(X.digits(F.col("postcode")), 4, "0").alias("postcode"), tokens("name").alias("words"))
    towns = t("postal_place").groupBy(F.col("postnummer").alias("postcode")).agg(F.min("poststed").alias("town")).select("postcode", tokens("town").alias("town"))
    hit = F.arrays_overlap("words", "town")
    return p.join(towns, "postcode").groupBy("postcode").agg(F.countDistinct("id").alias("places"), F.countDistinct(F.when(hit, F.col("id"))).alias("named_after_town"))


@query(f"""
WITH f AS (SELECT DISTINCT uuid, {sql_words("json_extract_string(ad_content, '$.title')", X.LEGAL_TITLE)} AS title, {sql_words("json_extract_string(ad_content, '$.employer.name')", X.LEGAL_TITLE)} AS employer FROM feed_entry WHERE ad_content IS NOT NULL)
SELECT uuid, title, employer FROM f WHERE title <> '' AND NOT EXISTS (SELECT 1 FROM active_ads a WHERE {sql_words("a.title", X.LEGAL_TITLE)} = f.title AND {sql_words("a.business_name", X.LEGAL_TITLE)} = f.employer)
""")
def title_anti_join(t) -> DataFrame:
    """Jobs of one source that the other doesn't have, by normalised title and employer."""
    f = t("feed_entry").where("ad_content is not null").select(
        "uuid", X.norm_title(F.get_json_object("ad_content", "$.title")).alias("title"), X.norm_title(F.get_json_object("ad_content", "$.employer.name")).alias("employer")
    )
    a = t("active_ads").select(X.norm_title(F.col("title")).alias("title"), X.norm_title(F.col("business_name")).alias("employer")).distinct()
    return f.where("title <> ''").distinct().join(a, ["title", "employer"], "left_anti").select("uuid", "title", "employer")


@query("""
WITH e AS (
  SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region
)
SELECT child, parent AS ancestor, 1 AS distance FROM e UNION ALL SELECT a.child, b.parent, 2 FROM e a JOIN e b ON a.parent = b.child
UNION ALL SELECT a.child, c.parent, 3 FROM e a JOIN e b ON a.parent = b.child JOIN e c ON b.parent = c.child
""")
def hierarchy_closure(t) -> DataFrame:
    """All ancestors of each node with their distance."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = t("customer").select(name("c", "c_custkey").alias("child"), name("n", "c_nationkey").alias("parent"))
    e = e.unionByName(t("nation").select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent")))
    return matching.ancestors(e.unionByName(t("region").select(name("r", "r_regionkey").alias("child"), F.lit("world").alias("parent"))))


@query("""
WITH x AS (SELECT snapshot_no, organisation_number AS org, unnest(evidence_ids) AS e FROM claims)
SELECT snapshot_no, count(*) AS links, count(DISTINCT e) AS evidence, count(DISTINCT org) AS organisations FROM x GROUP BY 1
""")
def evidence_bridge(t) -> DataFrame:
    """Claims and their evidence as one row for each link."""
    links = t("claims").select("snapshot_no", F.col("organisation_number").alias("org"), F.explode("evidence_ids").alias("e"))
    return links.groupBy("snapshot_no").agg(F.count("*").alias("links"), F.countDistinct("e").alias("evidence"), F.countDistinct("org").alias("organisations"))


@query(f"""
WITH c AS (
  SELECT {SQL_HOST.format("employer_homepage")} AS domain, 2 AS priority, uuid AS seen FROM active_ads WHERE employer_homepage IS NOT NULL
  UNION ALL SELECT {SQL_HOST.format("website")}, 1, osm_id FROM osm WHERE website IS NOT NULL AND osm_id IS NOT NULL
), b AS (SELECT *, min(seen) OVER (PARTITION BY domain) AS position, row_number() OVER (PARTITION BY domain ORDER BY priority, seen) AS r FROM (SELECT DISTINCT * FROM c))
SELECT domain, priority, seen, position FROM b WHERE r = 1
""")
def priority_dedup(t) -> DataFrame:
    """Candidates by domain: the best source wins, in the place where the domain was first seen."""
    a = t("active_ads").where("employer_homepage is not null").select(X.host(F.col("employer_homepage")).alias("domain"), F.lit(2).alias("priority"), F.col("uuid").alias("seen"))
    o = t("osm").where("website is not null and osm_id is not null").select(X.host(F.col("website")).alias("domain"), F.lit(1).alias("priority"), F.col("osm_id").alias("seen"))
    return choosing.priority_dedup(a.unionByName(o).distinct(), [], "domain", "priority", "seen")


@query("""
WITH o AS (
  SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'exact' WHEN 'O' THEN 'related' ELSE 'rejected' END AS verdict, o_orderpriority = '1-URGENT' AS strict, o_orderstatus = 'P' AS open FROM orders
), w AS (SELECT *, coalesce(max(open::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bar FROM o),
k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY verdict = 'related', o_orderkey) AS r FROM w WHERE verdict <> 'rejected' AND (bar = 0 OR strict))
SELECT o_custkey, o_orderkey, verdict FROM k WHERE r = 1
""")
def first_success_ladder(t) -> DataFrame:
    """First exact row of each key, else the first related; an open row before raises the bar."""
    verdict = F.when(F.col("o_orderstatus") == "F", "exact").when(F.col("o_orderstatus") == "O", "related").otherwise("rejected")
    rows = t("orders").select("o_custkey", "o_orderkey", verdict.alias("verdict"), (F.col("o_orderpriority") == "1-URGENT").alias("strict"), (F.col("o_orderstatus") == "P").alias("open"))
    return choosing.first_success(rows, ["o_custkey"], "o_orderkey", "verdict", "open").select("o_custkey", "o_orderkey", "verdict")


@query("""
WITH o AS (SELECT o_custkey, c_mktsegment, o_orderkey, o_totalprice, CASE c_mktsegment WHEN 'BUILDING' THEN 8 WHEN 'MACHINERY' THEN 5 ELSE 3 END AS cap FROM orders JOIN customer ON o_custkey = c_custkey),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS rank FROM o)
SELECT o_custkey, o_orderkey, rank FROM r WHERE rank <= cap
""")
def topk_per_tier(t) -> DataFrame:
    """Best rows of each key, as many as its tier allows."""
    cap = F.when(F.col("c_mktsegment") == "BUILDING", 8).when(F.col("c_mktsegment") == "MACHINERY", 5).otherwise(3)
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return choosing.top(rows, ["o_custkey"], [F.desc("o_totalprice"), F.desc("o_orderkey")], cap, 8).select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("""
WITH s AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1), m AS (SELECT max(ts) AS now FROM events)
SELECT c_custkey, recent FROM (
  SELECT c_custkey, c_acctbal, coalesce(last >= now - INTERVAL 7 DAY, FALSE) AS recent FROM customer LEFT JOIN s ON user_id = c_custkey CROSS JOIN m WHERE c_acctbal >= 0
) ORDER BY recent, c_acctbal DESC, c_custkey LIMIT 50
""")
def ranked_fallback(t) -> DataFrame:
    """The fifty largest of those not seen in seven days, then of the others (a top-k report)."""
    e = t("events")
    now = e.agg(F.max("ts")).first()[0]
    last = e.groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("ts").alias("last"))
    rows = t("customer").where("c_acctbal >= 0").join(last, "c_custkey", "left")
    rows = rows.withColumn("recent", F.coalesce(F.col("last") >= F.lit(now) - F.expr("interval 7 days"), F.lit(False)))
    return rows.orderBy("recent", F.desc("c_acctbal"), "c_custkey").limit(50).select("c_custkey", "recent")


@query("""
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY sha256('20260101:core:' || o_orderkey), o_orderkey) AS n FROM orders)
SELECT o_orderkey, CASE WHEN n <= 300 THEN 'dev' WHEN n <= 500 THEN 'val' ELSE 'test' END AS split FROM r WHERE n <= 700
""")
def stable_hash_split(t) -> DataFrame:
    """Disjoint samples of 300, 200 and 200 rows by hash (a sampling operator)."""
    rows = t("orders").select(F.col("o_orderkey"), F.col("o_orderkey").cast("string").alias("k"))
    return choosing.splits(rows, "k", 20260101, {"dev": 300, "val": 200, "test": 200}).select("o_orderkey", "split")


@query("""
WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('20260101:stress:' || p_partkey), p_partkey) AS n FROM part)
SELECT p_partkey, p_brand FROM r ORDER BY n, p_brand LIMIT 150
""")
def stress_round_robin(t) -> DataFrame:
    """150 rows, one from each bucket in turn (a sampling operator)."""
    rows = t("part").select("p_partkey", "p_brand", F.col("p_partkey").cast("string").alias("k"))
    return choosing.round_robin(rows, "p_brand", "k", 20260101, 150).select("p_partkey", "p_brand")


@query("SELECT c_custkey FROM customer ORDER BY sha256('7::' || c_custkey), c_custkey LIMIT 40")
def seeded_sample(t) -> DataFrame:
    """Forty rows that the seed picks (a sampling operator)."""
    h = choosing.hash_rank(F.col("c_custkey").cast("string"), 7)
    return t("customer").orderBy(h, "c_custkey").limit(40).select("c_custkey")
