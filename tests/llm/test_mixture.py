import numpy as np
import pandas as pd

from factline.llm import mixture as M


def cells(rows):
    return pd.DataFrame(rows, columns=["source", "lang", "topic", "docs", "tokens"])


def test_raking_meets_sources_and_margins():
    rng = np.random.default_rng(0)
    rows = [(s, g, t, 10, int(rng.integers(500, 5000))) for s in ("a", "b", "c") for g in ("nb", "en") for t in ("01", "02", "03")]
    out = M.rake(cells(rows), {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 3, "b": 3, "c": 3})
    w = out["tokens"] * out["expected"]
    share = w.groupby(out["source"]).sum() / w.sum()
    assert np.allclose(share[["a", "b", "c"]], [0.5, 0.3, 0.2], atol=1e-6) and (out["expected"] <= 3 + 1e-9).all()
    whole = out["tokens"].groupby(out["lang"]).sum() / out["tokens"].sum()
    assert np.allclose((w.groupby(out["lang"]).sum() / w.sum()).sort_index(), whole.sort_index(), atol=0.02)


def test_cap_bounds_the_total_and_absent_sources_are_spread():
    out = M.rake(cells([("small", "nb", "00", 2, 100), ("large", "nb", "00", 90, 9000), (None, "nb", "00", 1, 50), ("unlisted", "nb", "00", 1, 70)]), {"small": 0.4, "large": 0.4, "absent": 0.2}, {"small": 4, "large": 1, "absent": 9})
    e = dict(zip(out["source"], out["expected"], strict=True))
    assert np.isclose(e["small"], 4) and np.isclose(e["large"] * 9000, 400) and e[None] == e["unlisted"] == 0
    assert (M.rake(cells([]), {"a": 1.0}, {"a": 1})["expected"] == 0).all()


def test_mixture_keeps_caps_and_shares(spark):
    rng = np.random.default_rng(1)
    rows = [(i, ["big", "mid", "tiny", None, "zero"][min(4, int(rng.integers(0, 40) ** 0.5 // 1.3))] if i % 9 else "big", ["nb", "en"][i % 2], f"{i % 5:02d}", int(rng.integers(0, 900))) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, tokens long")
    weights = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.2, 5), ("none", 0.0, 1), (None, 0.1, 1)], "source string, target_share double, max_repeat int")
    m = M.mix(docs, weights)
    shares = {r.source: r for r in m.shares().collect()}
    for s, share, cap in (("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.2, 5)):
        assert abs(shares[s].actual_share - share) < 0.01 and shares[s].most_uses <= cap
    assert shares["none"].tokens == 0 and shares[None].tokens == 0
    again = M.mix(docs.repartition(7), weights).documents
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, m.documents.collect()))
    assert m.margins().where("margin = 'lang'").count() == 2
    assert M.mix(docs.limit(0), weights).documents.count() == 0


def test_sized_takes_topics_from_the_register(spark):
    docs = spark.createDataFrame([(1, "a b c", "nb", "s", "9", 0), (2, None, "x?", None, None, 0), (3, "", None, "s", "8", 0)], "doc_id long, text string, lang string, source string, organisation_number string, tokens int")
    body = "struct<organisasjonsnummer:string,naeringskode1:struct<kode:string>>"
    ents = spark.createDataFrame([(200, "2025-01-01", ("9", ("41.200",))), (200, "2024-01-01", ("9", ("10.1",))), (500, "2026-01-01", None), (200, "2024-01-01", ("8", None))], f"status int, snapshot_date string, body {body}")
    got = {r.doc_id: r for r in M.sized(docs, ents).collect()}
    assert (got[1].topic, got[1].tokens, got[2].lang, got[2].tokens, got[3].topic, got[3].lang) == ("41", 3, "other", 0, "00", "other")


def test_any_number_of_languages_has_margins(spark):
    docs = spark.createDataFrame([(i, "x y", f"{'abcdefghijkl'[i % 12]}x", "s", None) for i in range(24)] + [(99, "x", "??", "s", None)], "doc_id long, text string, lang string, source string, organisation_number string")
    ents = spark.createDataFrame([], "status int, snapshot_date string, body struct<organisasjonsnummer:string,naeringskode1:struct<kode:string>>")
    assert M.sized(docs, ents).select("lang").distinct().count() == 13


def test_total_is_a_parameter_and_the_caps_that_bind_are_told():
    rows = cells([("small", "nb", "00", 2, 100), ("large", "nb", "00", 90, 9000)])
    out = M.rake(rows, {"small": 0.5, "large": 0.5}, {"small": 4, "large": 1}, total=2000)
    assert out.attrs["binding"] == ["small"] and np.isclose(out.attrs["total"], 1400) and out.attrs["converged"]
    assert M.rake(rows, {"small": 0.5, "large": 0.5}, {"small": 4, "large": 1}).attrs["binding"] == ["small"]
    assert M.rake(rows, {"small": 0.5, "large": 0.5}, {"small": 4, "large": 1}, total=100).attrs["binding"] == []


def test_draw_keeps_the_margins_of_the_fit(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "ab"[i % 2], ["nb", "en", "nn"][int(rng.integers(0, 3))], f"{int(rng.integers(0, 20)):02d}", int(rng.integers(1, 900))) for i in range(6000)]
    weights = spark.createDataFrame([("a", 0.7, 1), ("b", 0.3, 2)], "source string, target_share double, max_repeat int")
    m = M.mix(spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, tokens long"), weights, total=900_000)
    got = m.margins().toPandas()
    for _, g in got.groupby("margin"):
        assert (g["fitted_tokens"] / g["fitted_tokens"].sum() - g["mixture_tokens"] / g["mixture_tokens"].sum()).abs().sum() / 2 < 0.02
    assert m.report().first().converged
