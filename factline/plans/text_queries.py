"""Queries of text, dates, JSON and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, jsons, marks, maths, names, pages
from ..functions import text as X
from ..functions.instants import instant
from ..operators import choosing
from .catalog import Catalog
from .matching_queries import REGISTER, SQL_FOLD, SQL_SITE, register, sql_words

catalog = Catalog()
query = catalog.query


@query(f"""
WITH n AS (SELECT business_name AS name FROM active_ads UNION SELECT name FROM place UNION SELECT name FROM osm)
SELECT name, {SQL_FOLD.format("name")} AS folded, {sql_words("name", X.LEGAL_CORE)} AS core, {sql_words("name", X.LEGAL_TITLE)} AS title FROM n WHERE name IS NOT NULL
""")
def fold_text(t) -> DataFrame:
    """Folded names, their cores and titles."""
    n = t("active_ads").select(F.col("business_name").alias("name")).unionByName(t("place").select("name")).unionByName(t("osm").select("name")).where("name is not null").distinct()
    return n.select("name", X.fold(F.col("name")).alias("folded"), X.name_core(F.col("name")).alias("core"), X.norm_title(F.col("name")).alias("title"))


@query(f"""
WITH {REGISTER}, n AS (SELECT DISTINCT b.navn AS name FROM reg WHERE b.navn IS NOT NULL)
SELECT name, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all({SQL_FOLD.format("name")}, '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({", ".join(f"'{w}'" for w in X.LEGAL_NAME)})))), ' ') AS tokens FROM n
""")
def token_core(t) -> DataFrame:
    """Distinct words of legal names without legal forms."""
    return register(t).select(F.col("body.navn").alias("name")).where("name is not null").distinct().select("name", F.array_join(F.array_sort(X.legal_name_core(F.col("name"))), " ").alias("tokens"))


@query(f"SELECT DISTINCT website, {SQL_SITE.format('website')} AS site FROM osm WHERE website IS NOT NULL")
def url_normalise(t) -> DataFrame:
    """One key for each site address."""
    return t("osm").where("website is not null").select("website", X.site_key(F.col("website")).alias("site")).distinct()


@query("""
SELECT o_orderkey, CASE WHEN v < 0 THEN '-' ELSE '' END || 'NOK ' || CASE WHEN abs(v) >= 1e9 THEN format('{:,.2f}', abs(v) / 1e9) || 'B' WHEN abs(v) >= 1e6 THEN format('{:,.2f}', abs(v) / 1e6) || 'M' ELSE format('{:,.0f}', abs(v)) END AS money
FROM (SELECT o_orderkey, o_orderkey * 1234567.0 * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS v FROM orders)
""")
def money_text(t) -> DataFrame:
    """Amounts as text in billions, millions or whole numbers."""
    v = F.col("o_orderkey") * F.lit(1234567.0) * F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)
    return t("orders").select("o_orderkey", X.format_money(v).alias("money"))


@query("""
WITH d AS (SELECT o_orderkey, printf('%09d', (o_orderkey * 7919) % 1000000000) AS n FROM orders),
s AS (SELECT *, CAST((11 - (3 * n[1]::INT + 2 * n[2]::INT + 7 * n[3]::INT + 6 * n[4]::INT + 5 * n[5]::INT + 4 * n[6]::INT + 3 * n[7]::INT + 2 * n[8]::INT) % 11) % 11 AS INT) AS c FROM d)
SELECT o_orderkey, n AS number, c = n[9]::INT AS valid FROM s
""")
def mod11_check(t) -> DataFrame:
    """The check digit of constructed numbers."""
    n = F.lpad(((F.col("o_orderkey") * 7919) % 1000000000).cast("string"), 9, "0")
    return t("orders").select("o_orderkey", n.alias("number"), X.valid_orgnr(n).alias("valid"))


@query("""
WITH w AS (SELECT doc_id, regexp_extract_all(text, 'org\\.nr\\. ?([0-9]{9})', 1) AS d FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, unnest(list_distinct(d)) AS n FROM w)
SELECT doc_id, n AS number FROM n WHERE CAST((11 - (3 * n[1]::INT + 2 * n[2]::INT + 7 * n[3]::INT + 6 * n[4]::INT + 5 * n[5]::INT + 4 * n[6]::INT + 3 * n[7]::INT + 2 * n[8]::INT) % 11) % 11 AS INT) = n[9]::INT
""")
def find_numbers(t) -> DataFrame:
    """Valid organisation numbers that texts label as such with nine digits in a row."""
    found = t("documents").where("text is not null").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"org\.nr\. ?([0-9]{9})"), 1))).alias("number"))
    return found.where(X.valid_orgnr(F.col("number")))


@query()
def find_org_numbers(t) -> DataFrame:
    """All valid organisation numbers of page texts, labelled or bare."""
    hits = t("page_fetch").where("text is not null").select("page_id", F.explode(X.find_org_numbers(F.col("text"))).alias("x"))
    return hits.groupBy("x.labelled").agg(F.count("*").alias("mentions"), F.countDistinct("x.digits").alias("numbers"))


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%d') AS iso, strftime(ts, '%Y-%m-%d') AS rfc, strftime(ts, '%Y-%m-%d') AS norwegian, strftime(ts, '%Y-%m-%d') AS dotted, strftime(ts, '%Y-%m-%d') AS english FROM events
""")
def date_parse(t) -> DataFrame:
    """Dates in five spellings, read back."""
    ts, f = F.col("ts"), F.date_format
    months = F.array(*[F.lit(m) for m in list(dates.MONTHS)[:12]])
    return t("events").select(
        "event_id", dates.feed_date(f(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("iso"), dates.feed_date(F.concat(F.lit("Mon, "), f(ts, "dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))).alias("rfc"),
        dates.text_date(F.concat(F.lit("Publisert "), f(ts, "d"), F.lit(". "), F.element_at(months, F.month(ts)), F.lit(" "), f(ts, "yyyy"))).alias("norwegian"),
        dates.text_date(f(ts, "dd.MM.yyyy")).alias("dotted"), dates.text_date(f(ts, "MMMM d, yyyy")).alias("english"),
    )


@query("""
WITH m AS (SELECT max(o_orderdate) AS now FROM orders)
SELECT o_orderstatus, CAST(count_if(o_orderdate >= now - INTERVAL 365 DAY) AS BIGINT) AS recent, count(*) AS orders FROM orders, m GROUP BY 1
""")
def within_days(t) -> DataFrame:
    """Rows of the last 365 days before the latest."""
    o = t("orders")
    now = o.agg(F.max("o_orderdate")).first()[0]
    return o.groupBy("o_orderstatus").agg(F.count_if(dates.within_days(F.col("o_orderdate"), F.lit(now), 365)).alias("recent"), F.count("*").alias("orders"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_path(t) -> DataFrame:
    """A member of a JSON column by its path."""
    return t("events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query()
def json_flatten(t) -> DataFrame:
    """Dotted keys of feed entries and how often each occurs."""
    rows = t("feed_entry").where("ad_content is not null").select(F.explode(jsons.json_flatten("ad_content")).alias("key", "value"))
    return rows.groupBy(F.regexp_replace("key", r"\.\d+", ".n").alias("key")).agg(F.count("*").alias("entries"), F.count_if(F.col("value") != "").alias("filled"))


@query("""
SELECT page_id, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title, len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS links FROM page_fetch WHERE html IS NOT NULL
""")
def html_title_links(t) -> DataFrame:
    """Title and number of links of pages, by patterns."""
    rows = t("page_fetch").where("html is not null")
    links = F.size(F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"]*)"'), 1)).cast("long")
    return rows.select("page_id", F.nullif(F.trim(F.regexp_extract("html", r"<title>([^<]*)</title>", 1)), F.lit("")).alias("title"), links.alias("links"))


PRIORITY_SQL = ", ".join(f"CASE WHEN contains(lower(u), '{w}') THEN {i} END" for i, w in enumerate(pages.PRIORITY_WORDS))


@query(f"""
WITH l AS (SELECT DISTINCT host, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS u FROM page_fetch WHERE html IS NOT NULL AND host IS NOT NULL),
r AS (SELECT host, u, least({PRIORITY_SQL}) AS priority FROM l), t AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY priority, u) AS n FROM r WHERE priority IS NOT NULL)
SELECT host, u AS url, CAST(priority AS INT) AS priority, n AS rank FROM t WHERE n <= 4
""")
def link_priority(t) -> DataFrame:
    """The four links of each host that are worth reading first."""
    rows = t("page_fetch").where("html is not null and host is not null").select("host", F.explode(F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"]*)"'), 1)).alias("url")).distinct()
    marks = F.least(*[F.when(F.lower("url").contains(w), F.lit(i)) for i, w in enumerate(pages.PRIORITY_WORDS)])
    best = choosing.top(rows.withColumn("priority", marks).where("priority is not null"), ["host"], [F.col("priority"), F.col("url")], 4)
    return best.withColumn("rank", F.col("rank").cast("long"))


def _contains(marks_: tuple) -> str:
    return "(" + " OR ".join("contains(lower(text), '{}')".format(m.replace("'", "''")) for m in marks_) + ")"


@query(f"SELECT page_id, trim(coalesce(text, '')) = '' OR coalesce({_contains(pages.PARKED_MARKS + pages.SERVER_MARKS)}, FALSE) OR coalesce(length(text) <= 900 AND coalesce(len(links), 0) <= 3 AND {_contains(pages.PLACEHOLDER_MARKS)}, FALSE) AS placeholder FROM page_fetch WHERE ok")
def placeholder_pages(t) -> DataFrame:
    """Pages that are parked, a server's default, a placeholder or empty."""
    text = F.col("text")
    few = (F.length(text) <= 900) & (F.coalesce(F.size("links"), F.lit(0)) <= 3) & marks.any_part(text, pages.PLACEHOLDER_MARKS)
    empty = F.trim(F.coalesce(text, F.lit(""))) == ""
    return t("page_fetch").where("ok").select("page_id", (empty | marks.any_part(text, pages.PARKED_MARKS + pages.SERVER_MARKS) | F.coalesce(few, F.lit(False))).alias("placeholder"))


@query()
def page_description(t) -> DataFrame:
    """Description, brand and date of each page, from linked data, meta values or its text."""
    rows = t("page_fetch").where("html is not null").select("page_id", "html")
    string = T.StringType()
    return rows.select("page_id", pages.over(pages.description, string)("html").alias("description"), pages.over(pages.brand, string)("html").alias("brand"), pages.over(pages.publication_date, string)("html").alias("published"))


@query()
def visible_text(t) -> DataFrame:
    """Digest and length of each page's visible text."""
    rows = t("page_fetch").where("html is not null").select("page_id", pages.over(pages.visible_text, T.StringType())("html").alias("v"))
    return rows.select("page_id", F.md5("v").alias("digest"), F.length("v").alias("length"))


@query()
def page_contacts(t) -> DataFrame:
    """Mail addresses and phones of pages, by host."""
    rows = t("page_fetch").where("html is not null and host is not null").select("host", F.explode(pages.over(pages.mails, pages.TEXTS)("html", "host")).alias("mail"))
    return rows.groupBy("host").agg(F.countDistinct("mail").alias("mails"), F.count_if(F.col("mail").endswith(F.concat(F.lit("@"), F.col("host")))).alias("own"))


def _words(words: tuple) -> str:
    return f"coalesce(regexp_matches(lower(text), '\\b(?:{'|'.join(words)})\\b'), FALSE)"


@query(f"""
WITH s AS (SELECT site, count_if({_words(marks.SPAM_STRONG)}) AS strong, count_if({_words(marks.SPAM_WEAK)} AND NOT {_words(marks.SPAM_STRONG)}) AS weak, count(*) AS documents FROM documents WHERE site IS NOT NULL GROUP BY 1)
SELECT site, documents FROM s WHERE coalesce(strong, 0) = 0 AND coalesce(weak, 0) < 2
""")
def spam_group_filter(t) -> DataFrame:
    """Sites of which no text has a strong mark of spam and fewer than two have a weak one."""
    s = t("documents").where("site is not null").select("site", marks.spam(F.col("text")).alias("m")).groupBy("site").agg(F.count_if(F.col("m") == 2).alias("strong"), F.count_if(F.col("m") == 1).alias("weak"), F.count("*").alias("documents"))
    return s.where("strong = 0 and weak < 2").select("site", "documents")


@query("""
WITH d AS (SELECT doc_id, site, CAST(retrieved_at AS DATE) AS day, count(*) OVER (PARTITION BY site, CAST(retrieved_at AS DATE)) AS n FROM documents WHERE site IS NOT NULL AND retrieved_at IS NOT NULL)
SELECT doc_id, site, n FROM d WHERE n < 3
""")
def import_day_filter(t) -> DataFrame:
    """Documents of days on which a site has fewer than three: no bulk imports. Days are counted before the join."""
    rows = t("documents").where("site is not null and retrieved_at is not null").select("doc_id", "site", F.to_date("retrieved_at").alias("day"))
    few = rows.groupBy("site", "day").agg(F.count("*").alias("n")).where("n < 3")
    return rows.join(few, ["site", "day"]).select("doc_id", "site", "n")


@query("""
WITH l AS (SELECT DISTINCT page_id, host, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1)) AS url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2)) AS label FROM page_fetch WHERE html IS NOT NULL AND host IS NOT NULL),
m AS (SELECT host, url FROM l GROUP BY 1, 2 HAVING count(DISTINCT page_id) >= 2 AND max(len(string_split_regex(trim(label), '\\s+'))) <= 2)
SELECT l.host, count(DISTINCT l.url) AS links FROM l WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.host = l.host AND m.url = l.url) GROUP BY 1
""")
def menu_link_filter(t) -> DataFrame:
    """Links of each host that aren't its menu's: those on one page only, or with a longer text."""
    both = lambda i: F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>'), i)
    rows = t("page_fetch").where("html is not null and host is not null").select("page_id", "host", F.explode(F.arrays_zip(both(1).alias("url"), both(2).alias("label"))).alias("x"))
    rows = rows.select("page_id", "host", "x.url", "x.label").distinct()
    uses = rows.groupBy("host", "url").agg(F.count_distinct("page_id").alias("pages"), F.max(F.size(F.split(F.trim("label"), r"\s+"))).alias("words"))
    return uses.where("not (pages >= 2 and words <= 2)").groupBy("host").agg(F.count("*").alias("links"))


@query("""
SELECT content_sha256, min(page_id) AS page_id, count(*) AS copies FROM page_fetch WHERE content_sha256 IS NOT NULL GROUP BY 1
""")
def content_dedup(t) -> DataFrame:
    """Each content once, with its first page and the number of copies."""
    return t("page_fetch").where("content_sha256 is not null").groupBy("content_sha256").agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"))


@query()
def workforce_extract(t) -> DataFrame:
    """Staff counts that documents state, by outcome and measure."""
    kind = T.StructType([T.StructField("status", T.StringType()), T.StructField("count", T.DoubleType()), T.StructField("measure", T.StringType())])
    rows = t("documents").select(pages.over(names.staff_count, kind)("text").alias("x"))
    return rows.groupBy("x.status", "x.measure").agg(F.count("*").alias("documents"), F.round(F.sum("x.count"), 3).alias("staff"))


@query("SELECT c_custkey, CASE WHEN c_acctbal IS NULL THEN 'unknown' WHEN CAST(c_acctbal AS INT) <= 0 THEN '0' WHEN CAST(c_acctbal AS INT) < 5 THEN '1-4' WHEN CAST(c_acctbal AS INT) < 20 THEN '5-19' WHEN CAST(c_acctbal AS INT) < 50 THEN '20-49' WHEN CAST(c_acctbal AS INT) < 250 THEN '50-249' ELSE '250+' END AS band FROM (SELECT c_custkey, floor(c_acctbal / 20) AS c_acctbal FROM customer)")
def size_bands(t) -> DataFrame:
    """Bands of a count."""
    return t("customer").select("c_custkey", maths.employee_band(F.floor(F.col("c_acctbal") / 20).cast("int")).alias("band"))


@query("""
WITH a AS (SELECT feed_slice, epoch_ms(coalesce(try_cast(sist_endret AS TIMESTAMPTZ), NULL)) AS ms FROM active_ads WHERE sist_endret IS NOT NULL),
b AS (SELECT min(ms) AS lo, max(ms) AS hi FROM a)
SELECT CAST(least(floor((ms - lo) * 8 / (hi - lo)), 7) AS INT) AS segment, count(*) AS ads FROM a, b GROUP BY 1
""")
def time_segments(t) -> DataFrame:
    """Ads in eight equal slices of the whole period."""
    a = t("active_ads").where("sist_endret is not null").select(F.unix_millis(instant(F.col("sist_endret"))).alias("ms"))
    lo, hi = a.agg(F.min("ms"), F.max("ms")).first()
    segment = F.least(F.floor((F.col("ms") - lo) * 8 / F.lit(hi - lo)), F.lit(7)).cast("int")
    return a.where("ms is not null").groupBy(segment.alias("segment")).agg(F.count("*").alias("ads"))
