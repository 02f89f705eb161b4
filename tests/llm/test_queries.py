"""Every query of the language-model data operators on the smallest tables, against truths that are found another way."""

import os
import unicodedata
from collections import defaultdict

import pytest

from factline.llm import plans

DATA = os.environ.get("FACTLINE_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def results(spark):
    return {name: (q(spark, DATA).columns, q(spark, DATA).collect()) for name, q in plans.queries().items()}


def test_columns_are_distinct(results):
    for name, (columns, rows) in results.items():
        assert len(set(columns)) == len(columns), name
        if name not in ("p3_confidence",):
            assert len({str(r) for r in rows}) == len(rows), name


def test_ids_are_those_of_the_tokenizer(spark, results):
    import tiktoken

    from factline.llm import bpe

    enc = tiktoken.Encoding("check", pat_str=bpe.PATTERN if hasattr(bpe, "PATTERN") else r"(?s).+", mergeable_ranks=bpe.read_ranks(bpe.VOCABULARY), special_tokens={}) if hasattr(bpe, "PATTERN") else None
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: list(r.ids) for r in results["p7_ids"][1]}
    assert set(got) == set(texts)
    ranks = {v: k for k, v in bpe.read_ranks(bpe.VOCABULARY).items()}
    for doc, text in texts.items():
        assert b"".join(ranks[i] for i in got[doc]).decode() == (text or "")
        if enc:
            assert got[doc] == enc.encode_ordinary(text or "")


def test_pairs_follow_from_the_forms(spark, results):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    by_form = defaultdict(set)
    for r in results["p9_forms"][1]:
        if texts[r.doc_id] and texts[r.doc_id].strip("​﻿ \n\t\xa0"):
            by_form[r.form].add(r.doc_id)
    want = {(a, b) for ids in by_form.values() for a in ids for b in ids if a < b and texts[a] != texts[b]}
    assert {tuple(r) for r in results["p9_found"][1]} == want
    for a, b in want:  # such pairs are equal to what compatibility forms say, or hold look-alikes or invisible signs
        assert unicodedata.normalize("NFKC", texts[a]) != texts[a] or unicodedata.normalize("NFKC", texts[b]) != texts[b] or not (texts[a] + texts[b]).isascii()


def test_links_are_pairs_of_different_tables(spark, results):
    tables = {}
    for name, key in (("active_ads", "uuid"), ("place", "id"), ("osm", "osm_id")):
        for r in spark.read.parquet(f"{DATA}/{name}.parquet").select(key).distinct().collect():
            tables[r[0]] = name
    for r in results["p3_found"][1]:
        assert r.key_1 < r.key_2 and tables[r.key_1] != tables[r.key_2]
    assert {tuple(r) for r in results["p3_found"][1]} == {(r.key_1, r.key_2) for r in results["p3_confidence"][1]}


def test_lines_are_of_their_pages_and_hold_headlines(spark, results):
    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/page_fetch.parquet").select("page_id", "text", "title").collect()}
    found = defaultdict(set)
    for r in results["p6_found"][1]:
        assert pages[r.page_id].text.split("\n")[r.line_no].strip()
        found[r.page_id].add(r.line_no)
    heads = [(p.page_id, i) for p in pages.values() if p.text and p.title and " – " in p.title for i, line in enumerate(p.text.split("\n")) if line.strip() == p.title.rsplit(" – ", 1)[0]]
    assert heads and sum(i in found[p] for p, i in heads) >= 0.9 * len(heads)


def test_mixture_is_within_its_caps(results):
    report = results["p8_report"][1][0]
    shares = results["p8_shares"][1]
    assert report.converged and all(r.most_uses is None or r.most_uses <= r.max_repeat for r in shares)
    assert abs(sum(r.actual_share for r in shares) - 1) < 1e-9
    used = defaultdict(int)
    for r in results["p8_mixture"][1]:
        used[r.source] += r.uses * r.tokens
    assert {r.source: r.tokens for r in shares if r.tokens} == dict(used)
