import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factline.operators import snapshot_diff as S


def test_hash_is_sparks(spark):
    rng = np.random.default_rng(1)
    cols = [rng.integers(-(2**63), 2**63 - 1, 500) for _ in range(3)]
    rows = spark.createDataFrame(list(zip(*[c.tolist() for c in cols], strict=True)), "a long, b long, c long")
    want = [r[0] for r in rows.select(F.xxhash64(F.lit(5).cast("long"), "a", "b", "c")).collect()]
    assert S.xx_longs(5, *cols).tolist() == want


def brute(rows):
    state = {}
    for s, k, v, at in rows:
        if s is not None and (at, v) >= state.setdefault(s, {}).get(k, ((-1, ""), None))[0]:
            state[s][k] = ((at, v), v)
    out, order = set(), sorted(state)
    for a, b in zip(order, order[1:], strict=False):
        for k in state[a].keys() | state[b].keys():
            x, y = state[a].get(k), state[b].get(k)
            if x is None or y is None or x[1] != y[1]:
                out.add((b, k, "added" if x is None else "removed" if y is None else "changed"))
    return out


@pytest.mark.parametrize("sizes", [{}, {"bucket_rows": 40, "first_cells": 16}])
def test_against_brute_force(spark, sizes):
    rng = random.Random(3)
    rows = []
    for s in (1, 2, 4, 5):
        for k in range(600):
            if rng.random() < 0.85:
                rows.append((s, f"k{k}", str(rng.randint(0, 3) if rng.random() < 0.3 else 9), 1))
    rows += [(2, "k1", "new", 2), (2, "k1", "new", 2)] + [(4, "hot", "h", i) for i in range(900)] + [(None, "x", "y", 1)]
    df = spark.createDataFrame(rows, "s int, k string, v string, at int").withColumn("change", F.lit("clash"))
    got = S.changes(df, "s", {"k": F.col("k")}, [F.col("v")], "at", **sizes).collect()
    assert {(r.snapshot, r.k, r.change) for r in got} == brute(rows)
    assert len(got) == len(set(got))


def test_all_rows_differ_and_empty_and_single(spark):
    df = spark.createDataFrame([(1, f"a{i}", "x", 1) for i in range(3000)] + [(2, f"b{i}", "x", 1) for i in range(3000)], "s int, k string, v string, at int")
    assert S.changes(df, "s", {"k": F.col("k")}, [F.col("v")], "at", first_cells=64).groupBy("change").count().orderBy("change").collect() == [("added", 3000), ("removed", 3000)]
    assert S.changes(df.limit(0), "s", {"k": F.col("k")}, [F.col("v")], "at").count() == 0
    assert S.changes(df.where("s = 1"), "s", {"k": F.col("k")}, [F.col("v")], "at").count() == 0


def test_null_keys_and_values_are_values(spark):
    df = spark.createDataFrame([(1, None, "x", None, 1), (2, None, None, None, 1), (1, "a", None, "b", 1), (2, "a", None, "b", 1), (1, "ab", None, None, None)], "s int, k string, v string, w string, at int")
    got = S.changes(df, "s", {"k": F.col("k"), "w": F.col("w")}, [F.col("v")], "at").collect()
    assert sorted(((r.k, r.change) for r in got), key=str) == [("ab", "removed"), (None, "changed")]


def test_failed_tables_are_told_by_the_digest():
    n = 200
    rng = np.random.default_rng(0)
    h = [rng.integers(-(2**62), 2**62, n) for _ in range(3)]
    check = S.xx_longs(S._CHECK, *h)
    for cells, fits in ((64, False), (1024, True)):
        width = cells // S.HASHES
        at, cols = [], []
        for i in range(S.HASHES):
            at.append(i * width + np.mod(S.xx_longs(i, *h), width))
        table = {}
        for i in range(n):
            for c in [-1, *(int(a[i]) for a in at)]:
                t = table.setdefault(c, [0, 0, 0, 0, 0])
                t[0] += 1
                for j, x in enumerate((*h, check)):
                    t[j + 1] ^= int(x[i])
        keys = np.array(list(table))
        cols = np.array(list(table.values()), np.int64)
        ok, guess, out = S.peel(cells, keys, *cols.T)
        assert ok is fits
        if fits:
            assert sorted(out[1].tolist()) == sorted(h[0].tolist()) and (out[0] == 1).all()
            cols[keys == -1, 4] ^= 1  # a wrong digest
            assert not S.peel(cells, keys, *cols.T)[0]
        else:
            assert guess > 64


def test_tables_hold_what_is_put_in_and_cancel_out():
    rng = np.random.default_rng(2)
    h = [rng.integers(-(2**62), 2**62, 500) for _ in range(3)]
    a, b = S.build(64, *h), S.build(64, *(x[:490] for x in h))
    assert a[0][:64].sum() == 4 * 500 and a[0][64] == 500
    gone = S.subtract(a, b)
    assert gone[0][64] == 10 and all((x == y).all() for x, y in zip(gone, S.build(64, *(x[490:] for x in h))))
    ok, _, out = S.peel(64, np.append(np.arange(64), -1), *gone)
    assert ok and sorted(out[1].tolist()) == sorted(h[0][490:].tolist())


def test_a_failed_bucket_is_built_again(spark, monkeypatch):
    sizes, build = [], S.build
    monkeypatch.setattr(S, "build", lambda cells, *h: sizes.append(cells) or build(cells, *h))
    rng = np.random.default_rng(4)
    a, b, v = (rng.integers(-(2**62), 2**62, 900) for _ in range(3))
    import pandas as pd

    rows = pd.DataFrame({"snapshot": [1] * 450 + [2] * 450, "h1": a, "h2": b, "v": v, "at": 1})
    out = S._compare([1, 2], 64)((0,), rows)
    assert len(out) == 900 and out["added"].sum() == 450 and max(sizes) > 64


def test_canonical_json(spark):
    texts = ['{"b": 1, "a": {"y": [1, 2], "x": null}, "checked_at": "t"}', '{"a":{"x":null,"y":[1,2]},"b":1}', '"æ\\u00f8"', '"æø"', "5", "not json", None, '{"checked_at": {"a": 1}, "k": "}\\"checked_at\\":1"}', "[]"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = [r[0] for r in rows.select(S.canonical_json(F.col("t"), ["checked_at"])).collect()]
    assert got[0] == got[1] and got[2] == got[3] and got[4] == "5" and got[5] == "not json" and got[6] is None and got[8] == "[]"
    assert json.loads(got[7]) == {"k": '}"checked_at":1'}
