import pytest
from pyspark.sql import functions as F

from factline.functions import dates, jsons, maths, names, pages
from factline.functions import text as X
from factline.functions.instants import instant, written_date


def one(spark, f, *values):
    kinds = {str: "string", int: "long", float: "double", type(None): "string"}
    row = spark.createDataFrame([values], ", ".join(f"c{i} {kinds[type(v)]}" for i, v in enumerate(values)))
    return row.select(f(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


TEXT = [
    (X.fold, "Trøndelag ÆØÅ Ærlig é ﬁ №", "trondelag aeoa aerlig e fi no"), (X.fold, None, ""), (X.name_core, "STIFTELSEN Blå-Ås AS (BA)", "bla"), (X.norm_title, "Kokk, avd. Oslo AS", "kokk oslo"),
    (X.core_name, " FRUKTKONGEN  AS under avvikling", "FRUKTKONGEN"), (X.core_name, "AS SLETTEBAKKVEIEN 104", "SLETTEBAKKVEIEN 104"), (X.strip_legal_tail, "Fisk Nord AS BA.", "Fisk Nord"), (X.strip_legal_tail, "AS", "AS"),
    (X.digits, "NO 979 543 883 MVA", "979543883"), (X.phone, "+47 22 33 44 55", "22334455"), (X.phone, "0047 22334455", "22334455"), (X.phone, "12345", None), (X.page_phone, "12345", "12345"),
    (X.valid_orgnr, "979543883", True), (X.valid_orgnr, "123456789", False), (X.valid_orgnr, None, False), (X.valid_orgnr, "97954388", False), (X.valid_orgnr, "97954388x", False),
    (X.registered_domain, "https://www.shop.example.co.uk:80/x?y", "example.co.uk"), (X.registered_domain, "post@mail.firma.no", "firma.no"), (X.registered_domain, "localhost", None), (X.registered_domain, " ", None),
    (X.site_key, "HTTPS://www.Firma.no/om//", "firma.no/om"), (X.site_key, None, ""), (X.with_scheme, " firma.no/ ", "https://firma.no"), (X.without_default_port, "https://a.no:443/x", "https://a.no/x"),
    (X.plain_text, " We, SELL:  fish! ", "we sell fish"), (X.label_of, "annualResult_total", "Annual result total"), (X.clip, "a" * 300, "a" * 197 + "..."),
    (X.format_money, -2_500_000_000.0, "-NOK 2.50B"), (X.format_money, 1_234_567.0, "NOK 1.23M"), (X.format_money, 999.0, "NOK 999"), (X.cut_sentence, "One. " + "b" * 500, "One."),
]


@pytest.mark.parametrize("case", TEXT, ids=range(len(TEXT)))
def test_text(spark, case):
    f, value, want = case
    assert one(spark, f, value) == want


def test_subunit_alias(spark):
    assert one(spark, X.subunit_alias, "DIPS AS AVD BERGEN", "DIPS AS") is None
    assert one(spark, X.subunit_alias, "HAGELAND HOKKSUND", "NORD HAGE AS") == "HAGELAND HOKKSUND"
    assert one(spark, X.subunit_alias, "AVD", "X") is None


def test_numbers_in_text(spark):
    got = one(spark, X.find_org_numbers, "Org.nr: 979 543 883 og 810034882, NO 979543883 MVA, 123456789")
    assert [(r.digits, r.labelled) for r in got] == [("979543883", True), ("810034882", False)]
    assert one(spark, X.find_org_numbers, None) == []
    assert one(spark, X.find_phones, "Ring 22 33 44 55 eller +47 22334455, ikke 123") == ["22334455"]


def test_same_site(spark):
    yes = [("a.no", "a.no"), ("a.no/en", "a.no"), ("a.no/x/y", "a.no/x")]
    no = [("a.no/shop", "a.no"), ("b.no", "a.no"), (None, "a.no"), ("a.no/xy", "a.no/x")]
    assert all(one(spark, X.same_site, *p) for p in yes) and not any(one(spark, X.same_site, *p) for p in no)


DATES = [
    (dates.feed_date, "Tue, 05 Mar 2024 10:00:00 +0100", "2024-03-05"), (dates.feed_date, "2024-03-05T10:00:00Z", "2024-03-05"), (dates.feed_date, "soon", None),
    (dates.text_date, "Publisert 5. mars 2024", "2024-03-05"), (dates.text_date, "05.03.2024", "2024-03-05"), (dates.text_date, "March 5, 2024", "2024-03-05"), (dates.text_date, "31. februar 2024", None), (dates.text_date, None, None),
    (written_date, "2024-03-05 10:00:00", "2024-03-05"), (written_date, "5.3.2024", "2024-03-05"), (written_date, "2024", None), (dates.millis_date, 1709632800000, "2024-03-05"),
]


@pytest.mark.parametrize("case", DATES, ids=range(len(DATES)))
def test_dates(spark, case):
    assert one(spark, case[0], case[1]) == case[2]


def test_instants_of_all_spellings_are_one(spark):
    same = ["2026-01-01T00:00:00Z", "2026-01-01T01:00:00.000+01:00", "2026-01-01 00:00:00", "1767225600000", "2026-01-01", " 2026-01-01T00:00:00.000000Z "]
    assert {one(spark, lambda c: F.unix_millis(instant(c)), v) for v in same} == {1767225600000}
    assert one(spark, lambda c: F.unix_millis(instant(c)), "later") is None and one(spark, lambda c: F.unix_millis(instant(c)), None) is None


def test_ages_and_numbers(spark):
    assert one(spark, dates.years_since, "2000-10-02", "2024-10-01") == 23 and one(spark, dates.years_since, "2000-10-01", "2024-10-01") == 24
    assert one(spark, dates.years_since, "x", "2024-10-01") is None
    assert one(spark, maths.pct_change, -100.0, 50.0) == 150.0 and one(spark, maths.pct_change, 0.0, 5.0) is None
    assert [one(spark, maths.employee_band, n) for n in (0, 4, 5, 49, 250)] == ["0", "1-4", "5-19", "20-49", "250+"]
    assert one(spark, maths.size_word, 9, 9e9) == "micro" and one(spark, lambda r: maths.size_word(F.lit(None).cast("int"), r), 2e8) == "medium-sized"


def test_json_flat_and_pieces():
    assert jsons.flat({"a": {"b": [1, None, "x"]}, "_links": 1, "c": [{"d": True}], "e": None}) == {"a.b": "1, x", "c.0.d": "true", "e": ""}
    text = '{ "a" : [ {"k": {"c": 1},  "v":  2.50 }, {"k": {"c": 2}, "v": "x"} ] }'
    assert jsons.piece(text, "$.a[0].v") == "2.50" and jsons.piece(text, "$.a[k.c=2]") == '{"k": {"c": 2}, "v": "x"}'
    assert jsons.piece(text, "$.b") is None and jsons.piece(text, "$..a") is None and jsons.piece("{", "$.a") is None


PAGE = """<html><head><title>Fisk &amp; Sild - Nordlaks</title><meta property="og:site_name" content="Nordlaks AS"><meta name="description" content=" Vi selger  fisk ">
<script type="application/ld+json">{"@graph":[{"@type":"NewsArticle","datePublished":"2024-02-03T10:00"},{"@type":"Organization","sameAs":["https://www.facebook.com/nordlaks/posts/1"]}]}</script></head>
<body><script>x()</script><h1>Fisk</h1><p>Hei <b>du</b></p><a href="/kontakt?x=1#y">Kontakt</a><a href="https://other.no/">ut</a><a href="https://linkedin.com/company/nordlaks/about">in</a>post@nordlaks.no</body></html>"""


def test_pages():
    assert pages.visible_text(PAGE).split("\n")[:2] == ["Fisk", "Hei du"] and pages.visible_text(None) is None
    assert pages.own_links(PAGE, "https://nordlaks.no/") == ["https://nordlaks.no/kontakt"] and pages.link_rank("https://a.no/kontakt") == 0
    assert pages.description(PAGE) == "Vi selger fisk" and pages.brand(PAGE) == "Nordlaks AS" and pages.publication_date(PAGE) == "2024-02-03"
    assert pages.social_links(PAGE) == [("facebook", "https://facebook.com/nordlaks"), ("linkedin", "https://linkedin.com/company/nordlaks")]
    assert pages.mails(PAGE, "nordlaks.no") == ["post@nordlaks.no"]
    assert pages.placeholder(None) and pages.placeholder("Domain is for sale", 1) and pages.placeholder("Domain is for sale" + "x" * 900)
    assert pages.placeholder("Coming soon", 1) and not pages.placeholder("Coming soon" + "x" * 900) and not pages.placeholder("Coming soon", 9)


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://facebook.com/sharer/x", None), ("https://facebook.com/profile.php?id=12345&x=1", "https://facebook.com/profile.php?id=12345"), ("https://facebook.com/profile.php?id=1", None), ("https://facebook.com/123_456", None),
        ("https://m.facebook.com/firma/photos/1", "https://facebook.com/firma"), ("https://twitter.com/firma", "https://x.com/firma"), ("https://x.com/firma/status/1", None), ("https://youtube.com/@firma/videos", "https://youtube.com/@firma"),
        ("https://youtu.be/abc", None), ("https://youtube.com/watch", None), ("https://linkedin.com/in/person", None), ("https://instagram.com/p/1", None), ("https://instagram.com/wix", None), ("https://tiktok.com/@firma", "https://tiktok.com/@firma"), ("http://[bad", None),
    ],
)
def test_social_profiles(url, want):
    got = pages.social_profile(url)
    assert (got and got[1]) == want


def test_feeds():
    rss = "<rss><channel><item><title>A  b</title><link>https://a.no/1</link><pubDate>Tue, 05 Mar 2024 10:00:00 +0100</pubDate></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>C</title><link rel="self" href="s"/><link href="https://a.no/2"/><published>2024-01-01</published><updated>2025-01-01</updated></entry></feed>'
    assert pages.feed_items(rss) == [("A b", "https://a.no/1", "Tue, 05 Mar 2024 10:00:00 +0100")] and pages.feed_items(atom) == [("C", "https://a.no/2", "2024-01-01")]
    assert pages.feed_items("<rss") == [] and pages.feed_items(None) == []


def test_names():
    assert names.registered_name("Vi i Hydema AS selger", "HYDEMA AS") == "Hydema AS"
    assert names.registered_name("Rapp Hydema AS selger. Selskapet Hydema AS.", "HYDEMA AS") == "Hydema AS"
    for text in ("Rapp Hydema AS", "K. Hydema AS", "super-Hydema AS", "hydema as", None):
        assert names.registered_name(text, "HYDEMA AS") is None
    assert names.staff_count("Selskapet har 1 234 ansatte i 2020") == ("found", 1234.0, "employees") and names.staff_count("12 årsverk") == ("found", 12.0, "full_time_equivalents")
    assert names.staff_count("5 ansatte, senere 7 ansatte")[0] == "conflict" and names.staff_count(None)[0] == "none"
    assert names.site_guesses("Blå Fisk Nord AS")[:4] == ["blafisknord", "bla-fisk-nord", "blafisk", "bla-fisk"] and "blaafisknord" in names.site_guesses("Blå Fisk Nord AS")


def test_a_verbatim_piece_is_whole():
    value = "x" * 5000
    assert jsons.piece('{"a": "' + value + '"}', "$.a") == f'"{value}"'
    assert jsons.piece('{"a": "' + value + '"}', "$.a", limit=10) == '"' + "x" * 9


def test_workforce_patterns(spark):
    from factline.functions.workforce import workforce

    texts = {
        "Selskapet har 1 250 ansatte og mer.": ("stated", "employees", 1250), "Gjennomsnittlig antall ansatte i 2023 var 12,5": ("stated", "average", 12), "Vi har 4 ansatte. Avdelingen har 9 ansatte.": ("conflict", "employees", None),
        "Totalt 7 ansatte": ("stated", "total", 7), "Utført 3,5 årsverk": ("stated", "man_years", 3), "Det er ingen ansatte her": ("none", "nobody", 0), "Siden 1999 har 2019 ansatte byttet": ("unknown", None, None), "": ("unknown", None, None), None: None,
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", workforce(F.col("t")).alias("w")).collect()
    assert {r.t: None if r.w is None else tuple(r.w) for r in rows} == texts
