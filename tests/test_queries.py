"""Every query against its SQL on the smallest tables; those without SQL must run with distinct column names."""

import math
import os

import duckdb
import pytest

from factline.plans import registry

DATA = os.environ.get("FACTLINE_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else repr(round(float(v), 6) + 0.0)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([plain(v[i]) for i in order]) for v in values)


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in os.listdir(DATA):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DATA}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sql, name):
    df = registry.queries()[name](spark, DATA)
    got = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name in registry.oracle_sql():
        want = sql.sql(registry.oracle_sql()[name])
        assert sorted(want.columns) == sorted(df.columns)
        assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_every_sql_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
