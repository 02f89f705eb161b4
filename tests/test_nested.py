import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factline.operators import nested

values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=20)


@settings(max_examples=150, deadline=None)
@given(values)
def test_round_trip_of_any_value(value):
    objects = {}
    root = nested.walk(value, objects)
    rows = {h: (k, c) for h, (k, c, _) in objects.items()}
    bridge = {h: children for h, (_, _, children) in objects.items()}
    assert nested.rebuild(root, rows, bridge) == json.loads(json.dumps(value))


def test_identity_ignores_member_order_only():
    a, b = {}, {}
    assert nested.walk({"x": 1, "y": [{"p": None, "q": 2}]}, a) == nested.walk({"y": [{"q": 2, "p": None}], "x": 1}, b)
    assert nested.walk([1, 2], {}) != nested.walk([2, 1], {})
    assert nested.walk({"a": []}, {}) != nested.walk({"a": None}, {}) != nested.walk({}, {})


def test_shred_stores_copies_once_and_keeps_places(spark):
    same = {"code": "X", "items": [{"n": 1}, None, {"n": 1}]}
    docs = [(str(i), json.dumps({"id": i, "groups": [same, same], "one": {"n": 1}})) for i in range(40)] + [("bad", "not json"), ("null", None), ("void", "{}"), ("list", '[{"n": 1}]')]
    t = nested.shred(spark.createDataFrame(docs, "key string, body string"), "key", "body")
    objects = {r.hash: (r.kind, r.content) for r in t.objects.collect()}
    bridge = {}
    for r in t.bridge.collect():
        bridge.setdefault(r.parent, []).append((r.member, r.ordinal, r.child))
    roots = {r.key: r.root for r in t.roots.collect()}
    assert sum(c == '{"n":1}' for _, c in objects.values()) == 1 and len(roots) == 43 and "null" not in roots
    for key, text in docs:
        if key not in ("bad", "null"):
            assert nested.rebuild(roots[key], objects, bridge) == json.loads(text)
    places = t.under(t.under(t.roots, "root", "groups", "group", "i"), "group", "items", "item", "j")
    real = t.content(places, "item", "content", t.objects["kind"] != "null").select("key", "i", "j").collect()
    assert sorted(map(tuple, real)) == sorted((str(k), i, j) for k in range(40) for i in (0, 1) for j in (0, 2))
    assert t.under(t.roots, "root", "one", "o", "i").select("i").distinct().collect()[0].i == 0


def test_latest_body_and_struct_bodies(spark):
    rows = spark.createDataFrame([("a", 1, [(1, None)]), ("a", 2, [(2, "x"), None]), ("a", 3, None), (None, 9, [(1, "y")])], "k string, at int, body array<struct<n:int,s:string>>")
    got = nested.latest_body(rows, "k", "at", "body").collect()
    assert [(r.key, json.loads(r.body)) for r in got] == [("a", [{"n": 2, "s": "x"}, None])]
    empty = nested.shred(nested.latest_body(rows.limit(0), "k", "at", "body"), "key", "body")
    assert empty.roots.count() == empty.objects.count() == empty.bridge.count() == 0


@pytest.mark.parametrize("depth", [50, 900, 2_000, 20_000, 100_000])
def test_deep_records_keep_all_levels(depth):
    objects = {}
    root = nested.walk_text("[" * depth + "]" * depth, objects)
    assert objects[root][0] == "array" and len(objects) == depth
    objects = {}
    root = nested.walk_text('{"city":"Oslo","a":' * depth + "1" + "}" * depth, objects)
    assert objects[root][:2] == ("object", '{"city":"Oslo"}') and len(objects) == depth


def test_deep_record_as_a_job(spark):
    text = '{"places":[{"city":"Oslo"}],"a":' * 5000 + "{}" + "}" * 5000
    t = nested.shred(spark.createDataFrame([("k", text)], "key string, body string"), "key", "body")
    assert t.content(t.under(t.roots, "root", "places", "place", "i"), "place", "content", t.objects["kind"] == "object").count() == 1
    assert t.objects.count() == 5002


@settings(max_examples=200, deadline=None)
@given(values, st.integers(0, 3))
def test_deep_parser_agrees(value, indent):
    text = json.dumps(value, indent=indent or None)
    assert nested.parse_deep(f" {text}\n") == json.loads(text)


@pytest.mark.parametrize("text", ["", "{", "[1,]", '{"a"}', '{"a":}', "[1 2]", "1 2", '{"a":1,}', "]", "[}", "nul", '{1:2}', "[,1]", '"x', ",", "{]"])
def test_deep_parser_refuses(text):
    with pytest.raises(ValueError):
        nested.parse_deep(text)


def test_lone_surrogates_are_kept_as_escapes(spark):
    rows = [("a", '{"x":"\\ud800","\\udfff":{"y":1},"z":["\\ud800"]}'), ("b", '"\\ud83d\\ude00"')]
    t = nested.shred(spark.createDataFrame(rows, "key string, body string"), "key", "body")
    contents = {r.content for r in t.objects.collect()}
    assert '{"x":"\\ud800"}' in contents and '"😀"' in contents
    assert {r.member for r in t.bridge.collect()} == {"\\udfff", "z"}


def test_identities_are_of_whole_parts():
    """Names that hold what parts an identity's text are other objects."""
    inner = nested.walk({}, {})
    a = nested.walk({"a": {}, "b": {}}, {})
    for sep in "\x1e\x1f,:0123456789":
        for n in (-1, 1, 2, 32):
            name = f"a{sep}{n}{sep}{inner}{sep}b"
            assert nested.walk({name: {}}, {}) != a
