import datetime as dt

import pytest
from pyspark.sql import functions as F

from factline.operators import history

BODY = "struct<organisasjonsnummer:string,navn:string,registreringsdatoEnhetsregisteret:string,historiskeNavn:array<struct<navn:string,fraDato:string,tilDato:string>>>"
SCHEMA = f"snapshot_date date, retrieved_at timestamp, status int, body {BODY}, navn string"
D = [dt.date(2025, 3, 31), dt.date(2025, 6, 30), dt.date(2025, 9, 30), dt.date(2025, 12, 31)]


def row(i, name, former=None, hour=1, status=200, reg="2000-01-02", org="1"):
    at = dt.datetime.combine(D[i], dt.time(hour))
    return (D[i], at, status, None if name is None and status != 200 else (org, name, reg, former), "clash")


def found(spark, rows):
    out = history.name_history(spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted(tuple(r) for r in out)


def test_rename_between_snapshots_uses_til_then_fra_then_snapshot(spark):
    rows = [row(0, "A AS"), row(1, " b  as"), row(2, "C AS", [("B AS", "2025-05-05 10:00:00", None)]), row(3, "D", [("C AS", None, "2025-11-01T10:00:00+01:00")])]
    assert found(spark, rows) == [("1", "A AS", "2000-01-02", "2025-05-05"), ("1", "B AS", "2025-05-05", "2025-09-30"), ("1", "C AS", "2025-09-30", "2025-11-01"), ("1", "D", "2025-11-01", "")]


def test_name_returns_and_change_within_a_quarter(spark):
    rows = [row(0, "A"), row(2, "A", [("B", "15.04.2025", "2025-05-01"), ("A", "2001-01-01", "2025-04-15")])]
    assert found(spark, rows) == [("1", "A", "2001-01-01", "2025-04-15"), ("1", "A", "2025-05-01", ""), ("1", "B", "2025-04-15", "2025-05-01")]


def test_latest_fetch_holds_failed_and_null_rows_dont_count(spark):
    rows = [row(0, "WRONG"), row(0, "A", hour=3), row(0, "A", hour=3), row(1, None, status=500), row(1, None), row(2, "A")]
    assert found(spark, rows) == [("1", "A", "2000-01-02", "")]


def test_former_name_without_dates_and_without_registration(spark):
    assert found(spark, [row(0, "B", [("A", None, None), (None, None, None)], reg=None)]) == [("1", "A", "2025-03-31", "2025-03-31"), ("1", "B", "2025-03-31", "")]


def test_empty(spark):
    assert found(spark, []) == []


def test_attribute_history_with_deletion(spark):
    rows = spark.createDataFrame([("k", 1, 1, "x"), ("k", 2, 1, "x"), ("k", 4, 1, "y"), ("o", 1, 1, None), ("o", 2, 1, None), ("o", 3, 1, None), ("o", 4, 2, None), ("o", 4, 1, "z"), (None, 1, 1, "n"), ("k", None, 1, "n")], "k string, s int, v int, a string")
    carried = sorted(map(tuple, history.attribute_history(rows, ["k"], "s", "v", ["a"]).collect()), key=str)
    assert carried == [("k", "x", 1, 4), ("k", "y", 4, None), ("o", None, 1, None)]
    deleted = sorted(map(tuple, history.attribute_history(rows, ["k"], "s", "v", ["a"], absent="delete").collect()), key=str)
    assert deleted == [("k", "x", 1, 3), ("k", "y", 4, None), ("o", None, 1, None)]


def test_hot_key_with_many_copies(spark):
    rows = [("k", 1 + i % 2, i, "ab"[i % 2]) for i in range(3000)] + [(str(i), 1, 1, "c") for i in range(50)]
    out = history.attribute_history(spark.createDataFrame(rows, "k string, s int, v int, a string"), ["k"], "s", "v", ["a"])
    assert out.count() == 52


def test_present_name_goes_on_after_a_former_name_without_end(spark):
    rows = [row(0, "A"), row(1, "A"), row(2, "A", [("B", "2025-05-01", None)]), row(3, "A")]
    assert found(spark, rows) == [("1", "A", "2000-01-02", "2025-05-01"), ("1", "A", "2025-06-30", ""), ("1", "B", "2025-05-01", "2025-06-30")]


def test_end_of_a_name_that_is_shown_longer_doesnt_count(spark):
    rows = [row(0, "A"), row(1, "A"), row(2, "B", [("A", None, "2025-05-05")]), row(3, "B")]
    assert found(spark, rows) == [("1", "A", "2000-01-02", "2025-09-30"), ("1", "B", "2025-09-30", "")]


def test_rows_come_from_the_differences(spark, monkeypatch):
    """When every row of a snapshot is taken as new, instead of what the join says, there is no result."""
    rows = [row(0, "A"), row(1, "A"), row(2, "B", [("A", None, "2025-05-05")]), row(3, "B")]

    def plain(now, keys, attrs, compared):
        return now.select(*keys, "_i", F.lit("inserted").alias("change"), *attrs, *[F.lit(None).cast(now.schema[a].dataType).alias(f"before_{a}") for a in attrs])

    assert {(r.change, r.name, r.before_name) for r in history.name_events(spark.createDataFrame(rows, SCHEMA)).where("kind = 1").collect()} == {("inserted", "A", None), ("unchanged", "A", "A"), ("changed", "B", "A"), ("unchanged", "B", "B"), ("deleted", None, "B")}
    monkeypatch.setattr(history, "differences", plain)
    with pytest.raises(Exception, match="no differences of snapshots"):
        found(spark, rows)


def test_a_snapshot_without_name_breaks_no_period(spark):
    assert found(spark, [row(0, "A"), row(1, None), row(2, "A"), row(3, "B")]) == [("1", "A", "2000-01-02", "2025-12-31"), ("1", "B", "2025-12-31", "")]
