import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factline.llm import bpe

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return bpe.Encoder(), lambda s: t.encode(s, add_special_tokens=False).ids


def test_texts_of_all_kinds(both):
    e, want = both
    for s in ("", " ", "\n\n  x", "<|endoftext|>", "Hello world's 123", "æøå ÆØÅ", "日本語の注文", "👨‍👩‍👧 👍🏽", "a\u0000b", "ﬁ½™", "don't DON'T", "x" * 5000, "ab " * 3000, "   x", "العربية"):
        assert e.encode(s) == want(s), s[:20]
    assert e.encode(None) == []


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_any_text(text):
    e = bpe.encoder()
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json")) if not hasattr(test_any_text, "t") else test_any_text.t
    test_any_text.t = t
    t.encode_special_tokens = True
    assert e.encode(text) == t.encode(text, add_special_tokens=False).ids


def test_segment_tree_finds_the_leftmost_least():
    rng = random.Random(1)
    for n in (1, 2, 7, 64, 100):
        values = [rng.choice([bpe._NONE, 1, 2, 3]) for _ in range(n)]
        tree = bpe.SegmentTree(values)
        for _ in range(60):
            least = min(values)
            assert tree.least() == (-1 if least >= bpe._NONE else values.index(least))
            i = rng.randrange(n)
            values[i] = rng.choice([bpe._NONE, 0, 1, 2, 5])
            tree.set(i, values[i])


def test_long_pieces_take_no_quadratic_time(both):
    import time

    e, want = both
    start = time.time()
    assert e.encode("q" * 200_000) == want("q" * 200_000)
    assert time.time() - start < 30


def test_dataframe(spark):
    rows = spark.createDataFrame([(1, "Hei på deg", "clash"), (2, "", "c"), (3, None, "c"), (3, None, "c")], "doc_id long, text string, ids string")
    got = bpe.encode(rows).collect()
    assert [(r.doc_id, r.ids == []) for r in sorted(got)] == [(1, False), (2, True), (3, True), (3, True)]
    assert bpe.encode(rows.limit(0)).count() == 0
    assert sorted((r.doc_id, r.tokens) for r in bpe.count_tokens(rows).collect())[1:] == [(2, 0), (3, 0), (3, 0)]
