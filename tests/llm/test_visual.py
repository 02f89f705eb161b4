import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factline.llm import visual

T = visual.transducer()


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("Ｈｅｉ！　x", "Hei! x"), ("å ö", "å ö"), ("а̊", "å"), ("p​a­d﻿", "pad"), ("1 000 x y", "1 000 x y"),
        ("рау", "pay"), ("KÅ", "KÅ"), ("ﬁsk", "fisk"), ("a\r\nb\rc", "a\nb\nc"), ("e​́", "é"), ("ⅾⅼ", "dl"), ("x‑y", "x-y"), ("ạ̇", "ạ̇"), ("a‍b", "ab"), ("a\u200eb\u2066c\u180e\u2062\u034f\ufe0f", "abc"), ("αν", "av"), ("Ӏ", "I"), ("օ", "o"), ("Ꭺ", "A"), ("\u1112\u1161\u11ab", "한"), ("\u1112\u1161\u200b\u11ab", "한"), ("e\u0344", "ë\u0301"), ("\u1fb3\u0309", "\u03b1\u0309\u0345"),
    ],
)
def test_same_looking(a, b):
    assert T.apply(a) == T.apply(b)


@pytest.mark.parametrize(("a", "b"), [("²", "2"), ("①", "1"), ("½", "1/2"), ("™", "TM"), ("№", "No"), ("é", "e"), ("ß", "ss"), ("A", "a"), ("a  b", "a b"), ("a b", "a\nb"), ("–", "-"), ("\U0001f468‍\U0001f469", "\U0001f468\U0001f469"), ("l", "I"), ("к", "k"), ("ｶ", "カ"), ("\u2764\ufe0f", "\u2764"), ("a\u202eb", "ab")])
def test_different_looking(a, b):
    assert T.apply(a) != T.apply(b)


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_idempotent_and_composed(text):
    form = T.apply(text)
    assert T.apply(form) == form
    assert T.apply(unicodedata.normalize("NFD", text)) == T.apply(unicodedata.normalize("NFC", text))


def test_table_is_checked():
    assert all(n.target is None or T.apply(n.target) == n.target for n in T.start.values())
    t = visual.Transducer()
    with pytest.raises(ValueError):
        t._put("а", t._node("o"))


def test_a_form_with_many_spellings_is_spread(spark, monkeypatch):
    from factline.operators import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 7)
    rows = [(i, "".join("аa"[i >> k & 1] for k in range(5))) for i in range(32)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert visual.same_looking(df).count() == 32 * 31 // 2
    classes = visual.classes_of(df)[0].collect()
    assert len(classes) == 32 and {(r.n, r.links, r.spellings) for r in classes} == {(1, 31, 32)}


def test_pairs_against_brute_force(spark):
    texts = ["pay", "pаy", "pаy", "pay", "рay", "other", "oth­er", None, "", " ", " ", "​", "single", "x²", "x2"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(100 + i, "copy", "c") for i in range(60)] + [(200, "cоpy", "c"), (200, "cоpy", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string")
    ids = sorted({(i, t) for i, t, _ in rows if t and T.apply(t).strip()})
    want = {(a, b) for a, x in ids for b, y in ids if a < b and x != y and T.apply(x) == T.apply(y)}
    got = visual.same_looking(df).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and len(want) > 60
    assert visual.same_looking(df.limit(0)).count() == 0


def test_long_text():
    assert len(T.apply("а̊ " * 200_000)) == 400_000
    assert T.apply("a" + "\u200b" * 300_000 + "b a\u0301") == "ab á" and T.apply("\u200b\u0301" + "e" + "\u00ad" * 9 + "\u0301").endswith("é")
