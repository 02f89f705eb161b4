import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factline.llm import linkage as L

TOWNS = frozenset(["hirkas", "velmemo", "nordre bo"])
V = L.Vocabulary({w: w for w in ("bakeri", "sjomat", "elektro", "frisor", "verksted", "transport", "bokhandel", "lys", "og", "lyd")} | {"bakery": "bakeri"}, frozenset(["katalog.no"]))


@pytest.mark.parametrize(("a", "b", "want"), [("abcde", "abcde", True), ("abcde", "abde", True), ("abcde", "abxde", True), ("abcde", "bacde", True), ("abcde", "abcdef", True), ("abcde", "badec", False), ("abcde", "abc", False), ("a", "", True), ("ab", "cd", False)])
def test_near(a, b, want):
    assert L.near(a, b) is L.near(b, a) is want


def test_near_is_damerau_one():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 5))) for _ in range(2))
        edits = {a} | {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in "ab"} | {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in "ab"} | {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
        assert L.near(a, b) is (b in edits)


def test_names_and_sites():
    assert L.name_tokens("Snoskæruden Bakery AS, avd. Hirkås", TOWNS, V) == (["snoskeruden", "bakeri"], "hirkas")
    assert L.name_tokens("AS  Fisk & Lys og . Nordre Bø", TOWNS, V)[1] == "nordre bo" and L.name_tokens(None, TOWNS, V) == ([], "")
    assert L.name_tokens("Faldo Bokhan. ennk", TOWNS, V)[0] == ["faldo", "bokhandel"]
    assert L.site("HTTPS://WWW.a-b.example/x?y") == "a-b.example" and L.site(None) == L.site("x") == ""


def test_vocabulary_is_learned_from_sites(spark):
    rows = [(f"Firma{i:02d} {w}", [f"firma{i:02d}.no", "https://katalog.no/x"]) for i in range(30) for w in (["Bakeri", "Bakery"] if i % 4 == 0 else [["Elektro", "Frisør", "Hotell"][i % 3]])]
    v = L.learn(spark.createDataFrame(rows, "name string, urls array<string>"), TOWNS)
    assert v.common["bakery"] == v.common["bakeri"] != v.common["elektro"] and "firma00" not in v.common and v.directories == {"katalog.no"}
    empty = L.learn(spark.createDataFrame([], "name string, urls array<string>"), TOWNS)
    assert empty.common == {} and empty.directories == frozenset()


def test_words_of_any_length_are_keys():
    assert "w:bo" in L.word_keys("bo runevo", V) and "w:bakeri" in L.word_keys("bakeri", V) and L.word_keys("", V) == []


def test_every_site_of_a_record_counts():
    a, b = ("kalomi bakeri", "x.no y.no", "", "", True), ("kalomi bakeri", "y.no z.no", "", "", True)
    assert L.votes(a, b, V)[0] == 1 and L.votes(a, ("kalomi bakeri", "q.no", "", "", True), V)[0] == -1


def test_large_blocks_ask_for_a_second_key(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abdefgik") for _ in range(9)) for _ in range(30)]
    rows = [(i, ("ad", "place")[i % 2], "hirkas", f"solberg {words[i // 2]}", "", "", "") for i in range(60)] + [(100, "ad", "hirkas", "solberg", "", "", ""), (101, "place", "hirkas", "solberg", "", "", "")]
    profile = spark.createDataFrame(rows, "id long, src string, town string, name string, site string, orgnr string, social string")
    got = {frozenset(r) for r in L._candidates(profile, V, 20).collect()}
    assert {frozenset((2 * i, 2 * i + 1)) for i in range(30)} | {frozenset((100, 101))} <= got and len(got) < 200


def test_every_pair_of_a_large_block_is_found(spark, monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choice("abdefgik") for _ in range(9)) for _ in range(240)]
    rows = [(i, ("ad", "place")[i % 2], "hirkas", f"solberg {words[i]}", "", "", "") for i in range(240)] + [(1000 + i, "ad", "hirkas", "", "kjopesenter.no", "", "") for i in range(210)] + [(2000, "osm", "hirkas", "", "kjopesenter.no", "", "")]
    profile = spark.createDataFrame(rows, "id long, src string, town string, name string, site string, orgnr string, social string").cache()
    want = {(i, j) for i in range(0, 240, 2) for j in range(1, 240, 2)} | {(1000 + i, 2000) for i in range(210)}
    got = [tuple(r) for r in L._crowded(L._blocks(profile, V, L.BLOCK)).collect()]
    assert len(got) == len(want) and set(got) == want
    monkeypatch.setattr(L, "PART", 7)
    assert {tuple(r) for r in L._crowded(L._blocks(profile, V, L.BLOCK)).collect()} == want
    assert L._crowded(L._blocks(profile, V, 300)) is None


def test_links_of_a_large_block_with_one_key_are_found(spark):
    rows, truth = tables()
    for src, key, _, _, urls, *_ in rows[:]:
        if src == "ad" and int(key[1:]) % 3 == 1:  # without a name
            rows.append(("osm", f"n{key[1:]}", None, None, urls, None, None))
            truth.add((key, f"n{key[1:]}"))
    one = {(f"x{i}", "y") for i in range(230)}
    rows += [("ad", a, "Gohudra", "Hirkås", ["gohudra.example"], f"8{i:08d}", None) for i, (a, _) in enumerate(sorted(one))] + [("osm", "y", None, None, ["gohudra.example"], None, None)]
    got = {(r.key_1, r.key_2) for r in L.link(spark.createDataFrame(rows, SCHEMA), TOWNS).collect()}
    assert one <= got and len(got & truth) / len(truth) > 0.95


def test_a_large_block_of_strangers_has_no_links(spark):
    rng = random.Random(8)
    stems = ["".join(rng.choice(["ka", "lo", "mi", "ne", "ru", "sti", "vo", "fje", "bra"]) for _ in range(5)) for _ in range(300)]
    rows, truth = tables()
    rows += [(src, f"{src}{i}", f"Solberg {s}", "Hirkås", [], None, None) for i, s in enumerate(stems) for src in ("ad", "place")]
    got = {(r.key_1, r.key_2) for r in L.link(spark.createDataFrame(rows, SCHEMA), TOWNS).collect()}
    truth |= {(f"ad{i}", f"place{i}") for i in range(300)}
    assert len(got & truth) / len(truth) > 0.95 and len(got & truth) / len(got) > 0.9


def test_shares_of_matches_are_those_of_the_pairs():
    x = np.array([[1, 1], [1, -1], [-1, 1], [-1, -1]])
    model = L.LabelModel(x, np.array([450.0, 50.0, 50.0, 450.0]), np.zeros(4))
    few, some = model._posterior(x + 1), model.among(x, np.array([1.0, 100, 100, 9000]))
    assert (some < few).all() and (model.among(x, np.array([1.0, 100, 100, 9000]), 1e-6) < some).all()
    assert np.allclose(model.among(x, np.zeros(4)), few)


def test_candidates_are_the_pairs_that_share_a_key(spark):
    rng = random.Random(5)
    names = [" ".join("".join(rng.choice("aabk") for _ in range(rng.randint(3, 6))) for _ in range(rng.randint(1, 2))) for _ in range(150)]
    rows = [(i, ("ad", "osm", "place")[i % 3], ("hirkas", "velmemo")[i % 2], n, f"{n[:3]}.no" if i % 4 == 0 else "", "", "") for i, n in enumerate(names)]
    keys = {r[0]: set(L.word_keys(r[3], V)) | set(L.company_keys(r[4], "", "", r[3], V)) for r in rows}
    want = {(r[0], s[0]) for r in rows for s in rows if r[1] < s[1] and r[2] == s[2] and keys[r[0]] & keys[s[0]]}
    profile = spark.createDataFrame(rows, "id long, src string, town string, name string, site string, orgnr string, social string").cache()
    got = L._candidates(profile, V).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert {tuple(r) for r in L._candidates(profile, V, 5).unionByName(L._crowded(L._blocks(profile, V, 5))).collect()} == want


def test_all_directories_are_left_out_however_many(spark, monkeypatch):
    rows = [(f"Firma{i:02d} {w}", [f"https://{d}.no/x" for d in ("katalog", "lister", "oversikt")] + [f"firma{i:02d}.no"]) for i in range(30) for w in (["Elektro", "Frisør", "Hotell", "Bakeri", "Sjømat"][i % 5],)]
    table = spark.createDataFrame([("ad", n, n, "Hirkås", urls, None, None) for n, urls in rows] + [("osm", "o", "Firma", None, ["katalog.no"], None, None), ("place", "p", None, None, None, None, None)], SCHEMA)
    read = lambda: sorted(map(tuple, L.profiles(table, TOWNS, L.learn(table, TOWNS)).collect()))
    want = read()
    assert {r[5] for r in want} == {"", *(f"firma{i:02d}.no" for i in range(30))}
    monkeypatch.setattr(L, "MAX_TOWNS", 2)
    assert read() == want


def test_label_model_learns_accuracies():
    rng = np.random.default_rng(0)
    n, accuracy = 4000, np.array([0.95, 0.9, 0.8, 0.7, 0.6])
    y = rng.random(n) < 0.5
    v = np.where(rng.random((n, 5)) < accuracy, np.where(y, 1, -1)[:, None], np.where(y, -1, 1)[:, None])
    v[rng.random((n, 5)) < 0.3] = 0
    patterns, inverse, counts = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    model = L.LabelModel(patterns, counts, np.zeros(len(counts)))
    got = model.post[inverse.ravel()] > 0.5
    assert (got == y).mean() > 0.93
    vote = v.sum(axis=1) > 0
    assert (got == y).mean() >= (vote == y).mean()


SCHEMA = "src string, key string, name string, town string, urls array<string>, orgnr string, social string"


def tables(n=120):
    rng = random.Random(7)
    stems = ["".join(rng.choice(["ka", "lo", "mi", "ne", "ru", "sti", "vo", "fje", "bra"]) for _ in range(4)) for _ in range(n)]
    trades = ["Bakeri", "Sjømat", "Elektro", "Frisør", "Verksted", "Transport"]
    rows, truth = [], set()
    for i, s in enumerate(stems):
        trade, town = trades[i % 6], ["Hirkås", "Velmemo"][i % 2]
        url = f"https://{s}{L.fold(trade)}.example"
        rows.append(("ad", f"a{i}", f"{s.title()} {trade} AS", town, [url if i % 3 else None], None, None))
        rows.append(("place", f"p{i}", f"{trade} {s[:-1]}" if i % 4 == 0 else f"{s} {trade[:4]}.", town, [f"www.{s}{L.fold(trade)}.example/#"] if i % 2 else [], None, None))
        if i % 3 == 0:
            rows.append(("osm", f"o{i}", f"{s.upper()} {trade}, avd {town}", None, None, None, None))
            truth |= {(f"a{i}", f"o{i}"), (f"o{i}", f"p{i}")}
        truth.add((f"a{i}", f"p{i}"))
        if i % 5 == 0:  # another trade under the same name
            rows.append(("place", f"q{i}", f"{s} {trades[(i + 1) % 6]}", town, [f"{s}{L.fold(trades[(i + 1) % 6])}.example"], None, None))
    return rows, truth


def test_precision_and_recall_on_known_cases(spark):
    rows, truth = tables()
    rows += [("ad", None, "x", None, None, None, None), ("ad", "nul", None, None, None, None, None), ("osm", "o-null", "", "", [None], "", "")] + rows[:1] * 200
    got = L.link(spark.createDataFrame(rows, SCHEMA), TOWNS).collect()
    pairs = {(r.key_1, r.key_2) for r in got}
    assert len(pairs & truth) / len(pairs) > 0.95 and len(pairs & truth) / len(truth) > 0.95
    assert len(pairs) == len(got) and all(r.key_1 < r.key_2 and 0.5 <= r.confidence <= 1 for r in got)


def test_empty(spark):
    assert L.link(spark.createDataFrame([], SCHEMA), TOWNS).count() == 0
    assert L.link(spark.createDataFrame([("ad", "a", "Only One AS", "Hirkås", None, None, None)], SCHEMA), TOWNS).count() == 0


def test_unknown_town_takes_the_only_one(spark):
    rows = [("ad", "a", "Kalomi Bakeri", "Hirkås", ["kalomibakeri.example"], None, None), ("osm", "o", "Kalomi Bakeri", None, ["kalomibakeri.example"], None, None), ("ad", "b", "Runevo Bakeri", "Hirkås", ["runevobakeri.example"], None, None), ("ad", "c", "Runevo Bakeri", "Velmemo", ["runevobakeri.example"], None, None), ("osm", "p", "Runevo Bakeri", None, ["runevobakeri.example"], None, None)]
    known = L.settle_towns(L.profiles(spark.createDataFrame(rows, SCHEMA), TOWNS, V), V).collect()
    assert {(r.key, r.town, r.seen) for r in known if r.src == "osm"} == {("o", "hirkas", False), ("p", "", False)}


def test_records_without_town_are_candidates_by_near_names(spark):
    rows = [("ad", "a", "Kalomi Bakeri", "Hirkås", None, None, None), ("osm", "slip", "Kalomni Bakeri", None, None, None, None), ("osm", "short", "Kalomi", None, None, None, None)]
    rows += [("ad", "b", "Fjo", "Velmemo", None, None, None), ("osm", "word", "FJO AS", None, None, None, None)]
    rows += [("ad", "c", "Runevo Elektro", "Hirkås", None, None, None), ("ad", "d", "Runevo Elektro", "Velmemo", None, None, None), ("osm", "two", "Runeva Elektro", None, None, None, None)]
    rows += [("osm", "e", "Stibravo Frisør", None, None, None, None), ("place", "f", "Stibrava Frisør", None, None, None, None), ("osm", "other", "Kalomi Elektro", None, None, None, None)]
    known = L.settle_towns(L.profiles(spark.createDataFrame(rows, SCHEMA), TOWNS, V), V).withColumn("id", F.xxhash64("src", "profile")).cache()
    got = {r.key: (r.town, r.id) for r in known.collect()}
    assert {k: t for k, (t, _) in got.items() if len(k) > 1} == {"slip": "hirkas", "short": "hirkas", "word": "velmemo", "two": "", "other": ""}
    pairs = {frozenset(r) for r in L._candidates(known, V).collect()}
    assert {frozenset((got[x][1], got[y][1])) for x, y in (("a", "slip"), ("a", "short"), ("b", "word"), ("e", "f"))} <= pairs
    assert frozenset((got["c"][1], got["two"][1])) not in pairs
