import json

import pytest
from pyspark.sql import functions as F

from factline.functions import marks


def one(spark, f, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(f(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


VALUES = [
    ({"amount": 12.5, "currency": "EUR"}, "12.50 EUR"), ({"amount": 7430288}, "7430288 NOK"), ({"url": "a.no", "platform": "x"}, "a.no"), ({"title": "Kokk", "employer_name": "A", "published": "2024-01-02T03"}, "Kokk — A — 2024-01-02"),
    ({"role_label": "Leder", "name": "B"}, "Leder: B"), ({"street": "Gata 1", "postcode": "0001", "city": "OSLO"}, "Gata 1, 0001 OSLO"), ({"code": "AS", "label": "Aksjeselskap"}, "Aksjeselskap (AS)"), ({"count": 5, "registered_at": "2024-01-01"}, "5 (registered 2024-01-01)"),
    (["a", "b"], "a, b"), ("tekst", "tekst"), (5, "5"), (2.5, "2.50"), (True, "true"),
]


@pytest.mark.parametrize("case", VALUES, ids=range(len(VALUES)))
def test_value_text(spark, case):
    assert one(spark, marks.value_text, json.dumps(case[0])) == case[1]


def test_marks_are_whole_words_where_it_matters(spark):
    assert one(spark, marks.hijacked, "Best online CASINO here") and not one(spark, marks.hijacked, "IBD nurse specialist") and not one(spark, marks.hijacked, None)
    assert [one(spark, marks.spam, t) for t in ("Birkin bags", "Casino venue", "Fish", None)] == [2, 1, 0, 0]


def test_page_states(spark):
    state = lambda t, n="0": one(spark, lambda a, b: marks.page_state(a, b.cast("int")), t, n)
    assert [state("This domain is for sale"), state("Welcome to nginx! " + "x" * 2000), state("Kommer snart"), state("Kommer snart", "9"), state("Page not found"), state("Vi selger fisk"), state(None)] == ["parked", "server default", "coming soon", None, "dead", None, None]


def test_industry_owner_and_system(spark):
    assert one(spark, marks.other_industry, "fishing", "Dagligvare og matbutikk") == "grocery_retail" and one(spark, marks.other_industry, "grocery_retail", "Dagligvare og matbutikk") is None and one(spark, marks.other_industry, None, "Dagligvare og matbutikk") is None
    assert one(spark, marks.copyright_owners, "© 2020-2024 Nordlaks AS\n(c) 2020 Daniel Eden\nCopyright Fisk & Sild Ltd") == ["Nordlaks AS", "Fisk & Sild Ltd"]
    got = one(spark, lambda c: marks.applicant_system(F.split(c, " ")), "https://a.no https://x.teamtailor.com/1 https://jobs.lever.co/x")
    assert tuple(got) == ("teamtailor", "https://x.teamtailor.com/1") and one(spark, lambda c: marks.applicant_system(F.split(c, " ")), "https://a.no") is None


def test_items_and_descriptions(spark):
    assert one(spark, marks.own_item, "Ny båt", "https://a.no/nyheter/1")
    for title, url in (("Comment on x", "u"), ("Hello, World!", "u"), ("x", "https://a.no/produkt/1"), ("x", "https://a.no/#comment-1"), ("Elementor #12", "u"), ("Test 2", "u")):
        assert not one(spark, marks.own_item, title, url), title
    assert one(spark, marks.usable_description, "Vi bygger hus i hele Norge.")
    for text in ("To ord", None, "Åpent mandag 08:00", "Velkommen til Nordlaks", "Vi bruker cookies på siden vår", "x" * 50 + " a b c", "Konferanse i oktober for alle", "Nordlaks AS driver i tillegg en butikk", "Page not found sorry"):
        assert not one(spark, marks.usable_description, text), text
