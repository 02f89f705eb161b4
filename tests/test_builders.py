import json

from pyspark.sql import functions as F

from factline.operators import claims, ladders

ROLES = "org string, body struct<rollegrupper:array<struct<type:struct<kode:string,beskrivelse:string>,sistEndret:string,roller:array<struct<type:struct<kode:string,beskrivelse:string>,person:struct<navn:struct<fornavn:string,mellomnavn:string,etternavn:string>>,enhet:struct<organisasjonsnummer:string,navn:array<string>>,avregistrert:boolean>>>>>"


def role(code, first=None, last=None, firm=None, gone=False):
    return ((code, code.title()), ((first, None, last),) if first else None, ("9", [firm]) if firm else None, gone)


def test_roles_and_their_latest_change(spark):
    body = ([(("STYR", "Styre"), "2024-01-02", [role("LEDE", "A", "B"), None, role("REVI", firm="Rev AS", gone=True), role("MEDL")]), (("DAGL", "x"), "2024-01-02", None), (("REGN", "x"), None, [])],)
    rows = spark.createDataFrame([("1", body), ("2", None), ("3", ([],)), ("4", (None,))], ROLES)
    got = sorted((r.value_key, r.status, json.loads(r.value).get("entity_organisation_number")) for r in claims.roles(rows).collect())
    assert got == [("LEDE|A B", "current", None), ("REVI|Rev AS", "withdrawn", "9")]
    assert [tuple(r) for r in claims.latest_role_change(rows).collect()] == [("1", "2024-01-02", "DAGL,STYR")]


def test_postings_from_both_shapes(spark):
    rows = spark.createDataFrame([("u", '{"title":"A","employer":{"orgnr":"979 543 883"},"workLocations":{"municipal":"X"}}'), ("v", '{"ad_content":{"title":"B","employer":{"orgnr":"979543883"},"workLocations":[{"municipal":"Y"}]}}'), ("w", "{}"), ("x", None), ("y", "bad")], "uuid string, ad_content string")
    got = sorted((r.value_key, json.loads(r.value)["municipality"]) for r in claims.postings(rows).collect())
    assert got == [("u", "X"), ("v", "Y")]


def test_evidence_joins_spans_once(spark):
    rows = spark.createDataFrame([("http://a", "x", "x"), ("http://a", "x", None), ("http://a", "y" * 600, "z"), (None, "x", "y")], "u string, a string, b string")
    got = claims.evidence(rows, F.col("u"), [F.col("a"), F.col("b")]).collect()
    assert sorted(len(r.span) for r in got) == [1, 500] and len({r.evidence_id for r in got}) == 2


def test_observed_times(spark):
    c = spark.createDataFrame([("c", ["e", "f"]), ("c", ["e"]), ("d", None)], "claim_id string, evidence_ids array<string>")
    e = spark.createDataFrame([("e", 5), ("f", 3)], "evidence_id string, retrieved_at int")
    assert [tuple(r) for r in claims.observed(c, e).collect()] == [("c", 3, 5)]


def test_first_rule_decides(spark):
    s = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "x"), ("b", "y"), ("c", "z")], "k string, kind string")
    got = ladders.gathered(s, ["k"]).withColumn("v", ladders.ladder([("first", ladders.has("x")), ("null", F.lit(None).cast("boolean")), ("second", ladders.has("y"))], "none")).collect()
    assert {r.k: (r.v, r.different) for r in got} == {"a": ("first", 2), "b": ("second", 1), "c": ("none", 1)}
    ranked = spark.createDataFrame([("a", "x", 2), ("a", "x", 1), ("a", "y", 0)], "k string, kind string, r int")
    assert [(r.kind, r["rank"]) for r in ladders.strongest(ranked, ["k"], "kind", "r").orderBy("rank").collect()] == [("y", 1), ("x", 2)]


def test_states(spark):
    s = spark.createDataFrame([(200, None, False), (200, None, True), (404, None, False), (429, None, False), (500, None, False), (200, "timeout", False), (None, None, False)], "s int, e string, x boolean")
    assert [r[0] for r in s.select(ladders.availability(F.col("s"), F.col("e"), F.col("x"))).collect()] == ["available", "not_available", "not_available", "blocked", "failed", "failed", "failed"]
    orgs = spark.createDataFrame([("1",), ("2",), ("2",)], "org string")
    states = spark.createDataFrame([("1", "a", "available", None), ("1", "b", "available", None), ("2", "a", "available", "r")], "org string, family string, availability string, reason string")
    full = ladders.filled(states, orgs, ["a", "b"])
    assert full.count() == 4 and {r.org: r.status for r in ladders.terminal(full).collect()} == {"1": "completed", "2": "partial"}
