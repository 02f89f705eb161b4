import pytest
from pyspark.sql import types as T

from factline.operators import incremental
from factline.runtime import work_path

SCHEMA = T.StructType([T.StructField("uuid", T.StringType()), T.StructField("ms", T.LongType()), T.StructField("note", T.StringType())])


def target(spark):
    return incremental.Target(spark, work_path(spark, "t"), SCHEMA, ["uuid", "ms"])


def source(spark, *keys):
    return spark.createDataFrame([(k, n, "x") for k, n in keys], SCHEMA)


def test_runs_process_each_version_once(spark):
    t, seen = target(spark), []

    def process(new):
        seen.append(sorted((r.uuid, r.ms) for r in new.collect()))
        return new

    assert t.version() == 0 and t.read().count() == 0
    t.run(source(spark, ("a", 1), ("b", 1)), process)
    t.run(source(spark, ("a", 1), ("a", 2), ("b", 1)), process)
    t.run(source(spark, ("a", 1), ("a", 2), ("b", 1)), process)
    assert seen == [[("a", 1), ("b", 1)], [("a", 2)], []]
    assert t.version() == 3 and t.read().count() == 3


def test_failure_before_publishing_repeats_and_skips_nothing(spark):
    t = target(spark)
    t.run(source(spark, ("a", 1)), lambda new: new)

    def broken(new):
        raise OSError("lost")

    with pytest.raises(OSError):
        t.run(source(spark, ("a", 1), ("b", 1)), broken)
    assert t.version() == 1
    t.propose([*t.segments(), t.stage(source(spark, ("zzz", 9)), 2)], 2)  # written, but never published
    assert t.read().count() == 1
    t.run(source(spark, ("a", 1), ("b", 1)), lambda new: new)
    assert sorted((r.uuid, r.ms) for r in t.read().collect()) == [("a", 1), ("b", 1)]


@pytest.mark.parametrize("step", ["stage", "propose", "commit", "segments", "after"])
def test_two_publishers_at_every_step_leave_one_intact_version(spark, step):
    """A publishes while B stands before each of its steps: B is refused, and A's version stays whole."""
    t = target(spark)
    t.publish(source(spark, ("base", 1)), 0)
    slow, fast = (incremental.Target(spark, t.path, SCHEMA, t.keys) for _ in "ba")

    def overtaken(*args, **kw):
        setattr(slow, step, plain)
        fast.publish(source(spark, ("a", 1)), 1)
        return plain(*args, **kw)

    if step == "after":
        fast.publish(source(spark, ("a", 1)), 1)
    else:
        plain = getattr(slow, step)
        setattr(slow, step, overtaken)
    with pytest.raises(RuntimeError):
        slow.publish(source(spark, ("b", 1)), 1)
    assert t.version() == 2 and len(t.segments()) == 2
    assert sorted(r.uuid for r in t.read().collect()) == ["a", "base"]
    assert [r.uuid for r in t.read(1).collect()] == ["base"]
    slow.run(source(spark, ("b", 1), ("a", 1)), lambda new: new)
    assert sorted(r.uuid for r in t.read().collect()) == ["a", "b", "base"]


def test_a_run_writes_only_its_new_rows(spark):
    t = target(spark)
    t.run(source(spark, ("a", 1), ("b", 1)), lambda new: new)
    t.run(source(spark, ("a", 1), ("b", 1), ("c", 1)), lambda new: new)
    last = t.segments()[-1]
    assert [r.uuid for r in spark.read.parquet(f"{t.path}/segments/{last}").collect()] == ["c"]


def test_compact_and_vacuum_keep_what_is_listed(spark):
    t = target(spark)
    for k in "abc":
        t.run(source(spark, (k, 1)), lambda new: new)
    t.compact()
    assert len(t.segments()) == 1 and t.read().count() == 3
    assert t.vacuum(keep=1) == []  # younger than any run under way
    assert len(t.vacuum(keep=1, older_ms=0)) == 3
    assert sorted(r.uuid for r in t.read().collect()) == ["a", "b", "c"]


def test_upserts_read_the_last_row_of_a_key(spark, monkeypatch):
    monkeypatch.setattr(incremental, "SEGMENTS", 3)
    t = incremental.Target(spark, work_path(spark, "u"), SCHEMA, ["uuid"])
    for n in range(1, 6):
        new = source(spark, ("a", n), (f"k{n}", n))
        t.upsert(lambda old, new=new: new, new)
    assert sorted((r.uuid, r.ms) for r in t.latest().collect()) == [("a", 5), *[(f"k{n}", n) for n in range(1, 6)]]
    assert len(t.segments()) < 4


def test_state_outlives_the_query(spark, tmp_path):
    from factline.plans import problems

    ads = spark.createDataFrame([("x", 1, "2026-01-01T00:00:00Z", "2026-01-01T00:00:00Z"), ("y", 1, "2026-01-01T00:00:00Z", "2026-03-01T00:00:00Z")], "uuid string, feed_slice int, sist_endret string, updated_at string")
    ads.write.parquet(f"{tmp_path}/active_ads.parquet")
    cursors = spark.createDataFrame([("slice-1", "2026-02-01T00:00:00Z", 1, "success")], "key string, value string, run_id int, run_status string").selectExpr("*", "timestamp'2026-01-01' as written_at")
    cursors.write.parquet(f"{tmp_path}/nav_feed_cursor.parquet")
    state = f"file://{tmp_path}/state"
    assert [r.uuid for r in problems.p2_found(spark, str(tmp_path), state).collect()] == ["y"]
    assert {(r.part, r.versions) for r in problems.p2_after_run(spark, str(tmp_path), state).collect()} == {("held", 2), ("left over", 0)}
    assert problems.p2_found(spark, str(tmp_path), state).count() == 0


def test_cursor_split_with_spellings_nulls_and_slices(spark):
    ads = spark.createDataFrame(
        [
            ("a", 1, "2026-01-01T00:00:00Z", "2026-01-01T12:00:00+02:00", "h"), ("a", 1, "2026-01-01T01:00:00+01:00", "2026-02-01T00:00:00Z", "h"), ("b", 1, "1767225600000", "2026-01-02T00:00:00", "h"),
            ("c", 2, "2026-01-01T00:00:00.5Z", "2026-01-05T00:00:00Z", "h"), ("d", 1, None, "2026-01-05T00:00:00Z", "h"), ("e", 1, "2026-01-01T00:00:00Z", None, "h"), ("f", None, "2026-01-01T00:00:00Z", "2020-01-01T00:00:00Z", "h"),
        ],
        "uuid string, feed_slice int, sist_endret string, updated_at string, cursor string",
    )
    cursors = spark.createDataFrame(
        [("slice-1", "2026-01-01T10:00:00Z", 2, "success"), ("slice-1", "2027-01-01T10:00:00Z", 3, "failed"), ("slice-1", "2025-01-01T10:00:00Z", 1, "success"), ("slice-1", None, 4, "success"), ("other", "1", 9, "success")],
        "key string, value string, run_id int, run_status string",
    ).selectExpr("*", "timestamp'2026-01-01' as written_at")
    held, late = (sorted(map(tuple, x.collect())) for x in incremental.split_by_cursor(incremental.ad_versions(ads), incremental.slice_cursors(cursors)))
    assert [u for u, _ in held] == ["a"] and [u for u, _ in late] == ["a", "b", "c", "f"]
    assert {ms for u, ms in late if u in "ab"} == {1767225600000}
