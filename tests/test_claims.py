import json

import pytest
from pyspark.sql import functions as F

from factline.functions import keys
from factline.operators import directory, quality, refresh
from factline.plans import claims_queries
from factline.sources import sinks

SCHEMA = "org string, family string, field string, value_key string, value string, period_start string, period_end string, status string"


def claim(family, field, key, value, end=None, status="current"):
    return ("o", family, field, key, json.dumps(value), None, end, status)


#: One case for each row of the decision table: before, after, checked, type of change, origin.
CASES = [
    (None, claim("jobs", "job", "1", "x"), True, "new_job", "new"),
    (None, claim("group", "link", "1", "x"), True, None, "new"),
    (None, claim("financials", "note", None, 1), True, "new_filing", "new"),
    (None, claim("website", "official_website", "", {"url": "a.no"}), True, "changed_website", "new"),
    (claim("identity", "name", None, "A"), claim("identity", "name", "", "A"), True, None, "kept"),
    (claim("identity", "name", None, "A"), claim("identity", "name", None, "B"), True, "identity_changed", "superseded"),
    (claim("description", "d", None, "We sell, fish."), claim("description", "d", None, "we sell fish"), True, None, "kept"),
    (claim("website", "official_website", None, {"url": "http://www.a.no/"}), claim("website", "official_website", None, {"url": "https://a.no"}), True, None, "kept"),
    (claim("financials", "revenue", None, 1, "2023-12-31"), claim("financials", "revenue", None, 2, "2023-12-31"), True, "changed_value", "superseded"),
    (claim("financials", "revenue", None, 1, "2023-12-31"), claim("financials", "revenue", None, 1, "2024-12-31"), True, "new_filing", "superseded"),
    (claim("activity", "item", "1", "x"), None, True, None, "withdrawn"),
    (claim("leadership", "role", "L|x", "x"), None, False, None, "carried"),
    (claim("leadership", "role", "L|x", "x"), None, True, "ended_role", "ended"),
    (claim("group", "link", "1", "x"), None, True, None, "ended"),
    (claim("identity", "name", None, "A"), None, True, "identity_changed", "ended"),
    (claim("leadership", "role", "L|x", "x"), claim("leadership", "role", "L|x", "x", status="withdrawn"), True, "ended_role", "ended"),
]


@pytest.mark.parametrize("case", CASES, ids=range(len(CASES)))
def test_decision_table(spark, case):
    before, after, seen, kind, origin = case
    frame = lambda c: spark.createDataFrame([c] if c else [], SCHEMA)
    states = spark.createDataFrame([("o", (before or after)[1], seen)], "org string, family string, checked boolean")
    assert [r.change_type for r in refresh.changes(frame(before), frame(after), states).collect()] == ([kind] if kind else [])
    got = refresh.merged(frame(before), frame(after), states).collect()
    assert [r.origin for r in got] == [origin] and (got[0].note == refresh.CARRIED) == (origin == "carried")


def test_checked(spark):
    rows = spark.createDataFrame([("available", None), ("not_available", "deadline hit"), ("failed", None), (None, None), ("not_applicable", "x")], "a string, r string")
    assert [r[0] for r in rows.select(refresh.checked(F.col("a"), F.col("r"))).collect()] == [True, False, False, False, True]


def test_keys_are_prefixes_of_sha256(spark):
    import hashlib

    row = spark.createDataFrame([("1", "jobs", "f", None)], "o string, a string, b string, k string")
    want = "c_" + hashlib.sha256(b"1|jobs|f|").hexdigest()[:20]
    assert row.select(keys.claim_id(*[F.col(c) for c in "oabk"])).first()[0] == want
    assert row.select(keys.change_id(F.lit("c"), F.lit("t"), F.col("k"), F.lit("1"))).first()[0] == "x_" + hashlib.sha256(b"c|t|null|1").hexdigest()[:20]
    assert row.select(keys.index_hash(F.array(F.lit("b"), F.lit("a")))).first()[0] == hashlib.sha256(b"a\nb\n").hexdigest()
    assert row.select(keys.contact_key("tel", F.lit("12345678"))).first()[0] == hashlib.sha256(b"tel:12345678").hexdigest()[:20]


def test_screens_abstain_from_what_they_dont_know(spark):
    rows = spark.createDataFrame([("1", 5, "x"), ("2", None, ""), ("3", 9, None)], "org string, n int, site string")
    assert [r.org for r in directory.screen(rows, [("n", ">", 1)], ("n", "desc"), 1).collect()] == ["3"]
    assert [r.org for r in directory.screen(rows, [("site", "present", None)]).collect()] == ["1"]
    for bad in ([("mood", "eq", 1)], [("n", "like", 1)]):
        with pytest.raises(directory.UnsupportedScreen):
            directory.screen(rows, bad)
    with pytest.raises(directory.UnsupportedScreen):
        directory.screen(rows, [], ("mood", "desc"))


def test_violations_and_scores(spark):
    rows = spark.createDataFrame([("a", 1), ("b", None), ("c", 5)], "k string, n int")
    got = quality.violations(rows, ["k"], {"none": F.col("n").isNull(), "big": F.col("n") > 3}).collect()
    assert sorted(map(tuple, got)) == [("b", "none"), ("c", "big")]
    p = quality.precision_recall(rows, [], F.col("n") > 9, F.lit(True), F.lit(True)).first()
    assert (p.precision, p.recall) == (None, 0.0)


def test_envelopes_nest_in_order(spark):
    c = spark.createDataFrame([("1", "b", "f", None, "c2"), ("1", "a", "f", "k", "c1")], "org string, family string, field string, value_key string, claim_id string")
    e = spark.createDataFrame([("1", "e2"), ("1", "e1")], "org string, evidence_id string")
    s = spark.createDataFrame([("2", "a", "failed")], "org string, family string, availability string")
    got = {r.org: r for r in sinks.envelopes(c, e, s, F.col("family")).collect()}
    assert [x.claim_id for x in got["1"].claims] == ["c1", "c2"] and [x.evidence_id for x in got["1"].evidence] == ["e1", "e2"] and got["2"].claims is None


def test_snapshots_are_added_once(spark):
    store = spark.createDataFrame([("a",)], "sha256 string")
    new = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2), (None, 3)], "sha256 string, n int")
    assert [r.sha256 for r in sinks.add_snapshots(store, new).collect()] == ["b"]


def test_every_run_is_compared_with_the_one_before(spark):
    schema = "snapshot_no int, organisation_number string, family string, field string, value_key string, value string, reporting_period struct<start: string, end: string>, status string, last_observed_at string, availability string"
    row = lambda no, v: (no, "o", "website", "official_website", None, json.dumps(v), None, "current", "2026-01-01", "available")
    claims = spark.createDataFrame([row(1, "a.no"), row(2, "a.no"), row(4, "b.no"), row(5, "a.no")], schema)
    t = lambda name: claims
    assert [r.snapshot_no for r in claims_queries.refresh_diff(t).orderBy("snapshot_no").collect()] == [4, 5]
    assert {(r.snapshot_no, r.origin) for r in claims_queries.refresh_carry_forward(t).collect()} == {(2, "kept"), (4, "superseded"), (5, "superseded")}
    assert [tuple(r) for r in claims_queries.change_summary(t).collect()] == [(4, "changed_website", 1, 1, 1), (5, "changed_website", 1, 1, 1)]


def test_sentences_size_by_revenue_where_staff_is_unknown(spark):
    facts = [("a", "A", None, 6e8, None, 0), ("b", "B", None, 3e7, "Bø", 1), ("c", "C", None, 5.0, None, 0), ("d", "D", 12, 6e8, None, 0)]
    rows = spark.createDataFrame(facts, "org string, name string, employees int, revenue double, municipality string, jobs long")
    got = dict(tuple(r) for r in claims_queries.sentences(rows).collect())
    assert got == {"a": "A is a large company.", "b": "B is a small company based in Bø, hiring (1 open ad).", "c": "C is a company.", "d": "D is a small company."}
