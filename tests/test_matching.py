import random

import pytest

from pyspark.sql import functions as F

from factline.operators import choosing, matching, skew, stats
from factline.plans import matching_queries


def test_hot_join_is_an_inner_join(spark):
    many = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(900)] + [(None, -1)], "k string, i int")
    few = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("k3", "c"), (None, "d")], "k string, x string")
    assert skew.hot_keys(many, "k", 100) == [("hot", 6)] and skew.hot_keys(many, "k") == []
    want = sorted(map(tuple, many.join(few, "k").select("k", "i", "x").collect()))
    assert len(want) == 1201
    for hot in (None, [], [("hot", 6)], [("hot", 3), ("k3", 2)]):
        assert sorted(map(tuple, skew.hot_join(many, few, "k", hot).select("k", "i", "x").collect())) == want


def test_any_number_of_hot_keys(spark, monkeypatch):
    many = spark.range(9000).selectExpr("concat('k', id % 300) as k", "id as i")
    found = skew.hot_keys(many, "k", 10)
    assert len(found) == 300 and {n for _, n in found} == {3}
    few = spark.range(300).selectExpr("concat('k', id) as k", "id as x")
    assert skew.hot_join(many, few, "k", found).where("i % 300 = x").count() == 9000
    left = skew.hot_join(many, few.where("x < 10"), "k", found, "left")
    assert left.count() == 9000 and left.where("x is null").count() == 8700
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 100)  # more hot keys than a list may have: the bound follows the rows
    assert skew.hot_keys(many, "k", 10) == []


def test_token_overlap_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(25)]
    sets = [sorted(rng.sample(words, rng.randint(0, 6))) for _ in range(160)]
    a = spark.createDataFrame([(f"a{i}", s) for i, s in enumerate(sets[:80])], "a string, tokens array<string>")
    b = spark.createDataFrame([(f"b{i}", s) for i, s in enumerate(sets[80:])], "b string, tokens array<string>")
    want = {(f"a{i}", f"b{j}") for i, x in enumerate(sets[:80]) for j, y in enumerate(sets[80:]) if x and y and len(set(x) & set(y)) / min(len(x), len(y)) >= 0.6}
    got = matching.token_overlap(a, b).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_either_key_gives_a_row_once(spark):
    rows = spark.createDataFrame([(1, "a", "a"), (2, "a", "b"), (3, None, "c"), (4, None, None)], "id int, x string, y string")
    keys = spark.createDataFrame([("a", 0), ("b", 0), ("a", 1), (None, 0)], "k string, z int")
    assert sorted((r.k, r.id) for r in matching.either_key(rows, ["x", "y"], keys, "k", ["id"]).collect()) == [("a", 1), ("a", 2), ("b", 2)]


def test_several_keys_name_what_agrees(spark):
    a = spark.createDataFrame([("l", "p", "", "n"), ("m", "", "", "")], "l string, tel string, mail string, name string")
    b = spark.createDataFrame([("r", "p", "", "n"), ("s", "q", "", "n")], "r string, tel string, mail string, name string")
    got = matching.several_keys(a, b, "l", "r", {"tel": ("tel", "tel"), "mail": ("mail", "mail"), "name": ("name", "name")}).collect()
    assert sorted((x.l, x.r, x.how, x.matches) for x in got) == [("l", "r", ["name", "tel"], 2), ("l", "s", ["name"], 1)]


def test_ancestors_to_any_depth_with_nulls_and_two_ways(spark):
    rows = [(f"n{i}", f"n{i + 1}") for i in range(40)] + [("n0", "n5"), ("d", None), (None, "n0"), ("n0", "n1"), ("n3", "n3")]
    got = {(r.child, r.ancestor): r.distance for r in matching.ancestors(spark.createDataFrame(rows, "child string, parent string")).collect()}
    want = {(f"n{i}", f"n{j}"): j - i for i in range(41) for j in range(i + 1, 41)}
    want |= {("n0", f"n{j}"): j - 4 for j in range(5, 41)}
    assert got == want
    assert matching.ancestors(spark.createDataFrame([], "child string, parent string")).count() == 0


def test_ancestors_refuse_a_cycle(spark):
    with pytest.raises(ValueError):
        matching.ancestors(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string"))


def test_cascade_takes_the_first_kind(spark):
    m = spark.createDataFrame([("o", "u", 2), ("o", "u", 1), ("o", "v", 3)], "org string, uuid string, rank int")
    assert sorted((r.uuid, r["rank"]) for r in matching.cascade(m, ["org", "uuid"], "rank").collect()) == [("u", 1), ("v", 3)]


def test_last_and_first_wins_with_ties_and_nulls(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", 2, "c"), ("k", None, "z"), (None, 1, "n")], "k string, o int, v string")
    assert {(r.k, r.v) for r in choosing.last_wins(rows, ["k"], F.col("o")).collect()} == {("k", "c"), (None, "n")}
    assert {(r.k, r.v) for r in choosing.first_wins(rows, ["k"], F.col("o")).collect()} == {("k", "z"), (None, "n")}


def test_compaction_drops_what_was_closed(spark):
    log = spark.createDataFrame([("a", 1, "ACTIVE"), ("a", 3, "INACTIVE"), ("b", 2, "INACTIVE"), ("b", 4, "ACTIVE"), ("b", 4, "ACTIVE"), ("a", 2, "ACTIVE")], "u string, seq int, status string")
    assert [r.u for r in choosing.compact(log, "u", [F.col("seq")], "status", "ACTIVE").collect()] == ["b"]


def test_splits_are_disjoint_and_stable(spark):
    rows = spark.range(500).select(F.col("id").cast("string").alias("k"))
    one = {r.k: r.split for r in choosing.splits(rows, "k", 1, {"a": 50, "b": 30}).collect()}
    two = {r.k: r.split for r in choosing.splits(rows.repartition(7), "k", 1, {"a": 50, "b": 30}).collect()}
    assert one == two and sorted(one.values()) == ["a"] * 50 + ["b"] * 30


def test_round_robin_takes_turns(spark):
    rows = spark.createDataFrame([("x", str(i)) for i in range(10)] + [("y", "a"), ("z", "b")], "b string, k string")
    got = [r.b for r in choosing.round_robin(rows, "b", "k", 1, 6).collect()]
    assert sorted(got) == ["x", "x", "x", "x", "y", "z"]


def test_priority_dedup_and_first_success(spark):
    c = spark.createDataFrame([("o", "d", 2, 1), ("o", "d", 1, 5), ("o", "e", 1, 3)], "org string, domain string, prio int, seen int")
    got = {r.domain: (r.prio, r.position) for r in choosing.priority_dedup(c, ["org"], "domain", "prio", "seen").collect()}
    assert got == {"d": (1, 1), "e": (1, 3)}
    v = spark.createDataFrame([("o", 1, "rejected", True, False), ("o", 2, "exact", False, False), ("o", 3, "related", False, True), ("p", 1, "related", False, False), ("p", 2, "exact", False, False)], "org string, n int, verdict string, open boolean, strict boolean")
    assert {(r.org, r.n) for r in choosing.first_success(v, ["org"], "n", "verdict", "open").collect()} == {("o", 3), ("p", 2)}


def test_nearest_rank_rounds_half_to_even(spark):
    import statistics

    rng = random.Random(2)
    for n in (1, 2, 3, 4, 10, 59):
        values = [rng.randint(0, 20) for _ in range(n)]
        df = spark.createDataFrame([("g", v) for v in values] + [("g", None)], "g string, v int")
        got = {r["share"]: r.v for r in stats.nearest_ranks(df, ["g"], "v", [0.5, 0.95]).collect()}
        assert got == {p: sorted(values)[round(p * (n - 1))] for p in (0.5, 0.95)}
    assert statistics


def test_counts_merge_both_columns(spark):
    df = spark.createDataFrame([("x", "x"), ("y", None), ("x", "z")], "a string, b string")
    assert {(r.value, r.n, r.m) for r in stats.counts_of(df, {"n": "a", "m": "b"}).collect()} == {("x", 2, 1), ("y", 1, 0), ("z", 0, 1)}


def test_no_child_is_left_out(spark):
    tables = {"nation": spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "n_nationkey int, n_name string")}
    tables["customer"] = spark.createDataFrame([(1, "x", 1, 9500.0), (2, "y", 1, -3.0), (3, "z", 2, 0.0), (4, "x", 1, None)], "c_custkey int, c_name string, c_nationkey int, c_acctbal double")
    got = {tuple(r) for r in matching_queries.children_of_parents(tables.get).collect()}
    assert got == {("A", "x", 1, 3), ("A", "y", 2, 3), ("A", "x", 4, 3), ("B", "z", 3, 1)}


def test_nearest_ranks_with_a_value_far_off(spark, monkeypatch):
    monkeypatch.setattr(stats, "ORDERED", 5)
    values = [float(i) / 7 for i in range(2000)] + [1e12]
    df = spark.createDataFrame([("g", v) for v in values] + [("h", 1.0)] * 9, "g string, v double")
    got = {(r.g, r.share): r.v for r in stats.nearest_ranks(df, ["g"], "v", [0.0, 0.5, 0.95, 1.0]).collect()}
    for share in (0.0, 0.5, 0.95, 1.0):
        assert got["g", share] == sorted(values)[round(share * (len(values) - 1))] and got["h", share] == 1.0
