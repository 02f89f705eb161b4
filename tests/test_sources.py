import gzip
import json

import pytest
from pyspark.sql import functions as F

from factline.sources import readers, sinks
from factline.streaming import feed


def test_key_lists(spark, tmp_path):
    for name, text in (("a.txt", "﻿979 543 883\nbad\n979543883\n810034882\n"), ("b.json", '["979543883", "x", "810034882"]'), ("c.json", '{"organisation_numbers": ["979543883", "810034882"]}'), ("d.jsonl", '{"organisation_number": "979543883"}\n{"organisation_number": "810034882"}\n')):
        (tmp_path / name).write_text(text, encoding="utf-8")
        got = readers.key_list(spark, str(tmp_path / name)).orderBy("position").collect()
        assert [r.organisation_number for r in got] == ["979543883", "810034882"], name
    assert readers.key_list(spark, str(tmp_path / "a.txt"), checked=False).count() == 4
    (tmp_path / "e.txt").write_text("none\n")
    with pytest.raises(ValueError):
        readers.key_list(spark, str(tmp_path / "e.txt"))


def test_bulk_csv_by_its_bytes_not_its_name(spark, tmp_path):
    text = 'organisasjonsnummer,navn,forretningsadresse.poststed\n1,"A ""x"", B",OSLO\n2,,\n'
    (tmp_path / "b.csv").write_bytes(gzip.compress(text.encode()))
    got = readers.bulk_csv(spark, str(tmp_path / "b.csv"), ["organisasjonsnummer", "NAVN", "forretningsadresse.poststed", "missing"], local=True).collect()
    assert [tuple(r) for r in got] == [("1", 'A "x", B', "OSLO", None), ("2", None, None, None)]
    assert readers.bulk_ok(str(tmp_path / "b.csv"))
    (tmp_path / "c.csv").write_bytes(gzip.compress(text.encode())[:-9])
    assert not readers.bulk_ok(str(tmp_path / "c.csv"))
    row = spark.createDataFrame([("12", "x", "TRUE", " ")], "a string, b string, c string, d string")
    assert tuple(row.select(readers.typed(F.col("a"), "int"), readers.typed(F.col("b"), "int"), readers.typed(F.col("c"), "boolean"), readers.typed(F.col("d"), "double")).first()) == (12, None, True, None)


def test_json_rows_labels_and_positions(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"organisation_number": "1", "v": 1}\nbroken\n{"organisation_number": "2", "v": 2}\n')
    (tmp_path / "b.jsonl").write_text('{"organisation_number": "2", "v": 3}\n')
    ddl = "organisation_number string, v int"
    assert readers.json_rows(spark, str(tmp_path / "a.jsonl"), ddl).count() == 2
    assert readers.json_rows(spark, str(tmp_path / "none.jsonl"), ddl).count() == 0
    with pytest.raises(FileNotFoundError):
        readers.json_rows(spark, str(tmp_path / "none.jsonl"), ddl, missing_ok=False)
    got = readers.labels(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")], ddl).collect()
    assert sorted((r.organisation_number, r.v) for r in got) == [("1", 1), ("2", 3)]
    (tmp_path / "p.jsonl").write_text('["id1", "Name", null, ["k"]]\n["id2"]\n')
    got = readers.position_rows(spark, str(tmp_path / "p.jsonl"), ["id", "name", "postcode", "keys"]).orderBy("position").collect()
    assert [tuple(r)[:4] for r in got] == [("id1", "Name", None, '["k"]'), ("id2", None, None, None)]


def test_feed_pages_read_twice_give_events_once(spark):
    page = json.dumps({"id": "p", "items": [{"id": "i", "title": "t", "_feed_entry": {"uuid": "u", "status": "ACTIVE", "businessName": "b", "sistEndret": "2024-01-01"}}, {"id": "j"}]})
    pages = spark.createDataFrame([(page, 1), (page, 2), ("{", 3)], "value string, position long")
    got = readers.feed_events(pages).collect()
    assert [(r.uuid, r.status, r.title, r.modified) for r in got] == [("u", "ACTIVE", "t", "2024-01-01")]


def test_answers_of_providers(spark):
    def read(f, text, *args):
        return [tuple(x) if not isinstance(x, (str, dict)) else x for x in spark.createDataFrame([(text,)], "t string").select(f(F.col("t"), *args)).first()[0]]

    assert read(readers.job_postings, '{"jobs":[{"title":"A","absolute_url":"u","updated_at":"2024-01-02T00:00"}]}', "greenhouse") == [("A", "u", "2024-01-02")]
    assert read(readers.job_postings, '[{"text":"A","hostedUrl":"u","createdAt":1709632800000}]', "lever") == [("A", "u", "2024-03-05")]
    assert read(readers.wordpress_posts, '[{"date":"2024-01-02T03:04","link":"u","title":{"rendered":"A"}},{"date":"x"}]') == [("A", "u", "2024-01-02")]
    assert read(readers.search_results, '{"organic":[{"link":"u"}]}') == ["u"] and read(readers.search_results, '{"web":{"results":[{"url":"v"}]}}') == ["v"]
    assert read(readers.bindings, '{"results":{"bindings":[{"item":{"type":"uri","value":"Q1"}}]}}') == [{"item": "Q1"}]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("b", None), ("a", 1)], "k string, v int")
    sinks.write_json(rows, str(tmp_path / "j"), "k", 1)
    assert [r.k for r in spark.read.json(str(tmp_path / "j")).collect()] == ["a", "b"]
    sinks.write_csv(rows, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    assert sinks.markdown(rows.orderBy("k"), "T").startswith("# T\n\n| k | v |\n|-|-|\n| a | 1 |")


EVENTS = "key string, status string, at long"


def test_state_in_any_order_equals_batch(spark):
    import random

    rng = random.Random(4)
    log = [(f"k{rng.randint(0, 20)}", rng.choice(["ACTIVE", "INACTIVE"]), at) for at in range(200)]
    whole = sorted(map(tuple, feed.batch_state(spark.createDataFrame(log, EVENTS)).select("key", "status", "at").collect()))
    state = spark.createDataFrame([], feed.STATE)
    for part in (log[:70], log[50:120], log[:70], log[120:]):  # replays and overlaps
        state = spark.createDataFrame(feed.fold_events(state, spark.createDataFrame([*part, (None, "x", 1), ("n", "x", None)], EVENTS)).collect(), feed.STATE)
    assert sorted(map(tuple, state.select("key", "status", "at").collect())) == whole
    assert state.agg(F.sum("events")).first()[0] == 200
    assert all(r.status == "ACTIVE" and r.at >= 100 for r in feed.live(state, "ACTIVE", 100).collect())


def test_stream_keeps_up_over_restarts(spark, tmp_path):
    source, target = tmp_path / "in", feed.target(spark, f"file://{tmp_path}/state")
    for n, rows in enumerate(([("a", "ACTIVE", 1), ("b", "ACTIVE", 2)], [("a", "INACTIVE", 3), ("b", "INACTIVE", 1)])):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(EVENTS).parquet(str(source))
        feed.keep_up(stream, target, str(tmp_path / "check")).awaitTermination()
        assert target.version() == n + 1
    assert sorted((r.key, r.status) for r in target.latest().collect()) == [("a", "INACTIVE"), ("b", "ACTIVE")]


def test_windows(spark):
    rows = spark.createDataFrame([("a", "2024-01-01 00:01:00"), ("a", "2024-01-01 00:09:00"), ("a", "2024-01-01 00:11:00")], "k string, t string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r.events for r in feed.windows(rows, "t", "10 minutes", "1 hour", "k").collect()) == [1, 2]
