"""The event feed as a stream: the same compaction as in batch, kept up by Structured Streaming.

State is a table in published versions (operators.incremental.Target). Each micro-batch is reduced to the last event of
each key and folded into the rows of its own keys, which alone are read and written again; an event older than what the
state holds changes nothing, so replays and late slices are harmless. Offsets live in the checkpoint, versions in the
target: a batch that is run again after a failure finds its events in the state already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.choosing import last_wins
from ..operators.incremental import Target

STATE = T.StructType([T.StructField("key", T.StringType()), T.StructField("status", T.StringType()), T.StructField("at", T.LongType()), T.StructField("first_at", T.LongType()), T.StructField("events", T.LongType())])


def fold_events(state: DataFrame, events: DataFrame) -> DataFrame:
    """The state after events (key, status, at): the last status of each key, when it was first seen, how many events.

    An event that the state has seen (at or before its last) is counted only if it is new to the key. Null keys and
    times drop out; of events at one time the greatest status is the last.
    """
    good = events.where("key is not null and at is not null").select("key", "status", "at").distinct()
    known = state.select("key", F.col("at").alias("_at"))
    fresh = good.join(known, "key", "left").where("_at is null or at > _at").drop("_at")
    step = fresh.groupBy("key").agg(F.max(F.struct("at", "status")).alias("m"), F.min("at").alias("first_at"), F.count("*").alias("events"))
    new = step.select("key", F.col("m.status").alias("status"), F.col("m.at").alias("at"), "first_at", "events")
    both = state.select(*STATE.fieldNames()).unionByName(new)
    sums = both.groupBy("key").agg(F.max(F.struct("at", "status")).alias("m"), F.min("first_at").alias("first_at"), F.sum("events").alias("events"))
    return sums.select("key", F.col("m.status").alias("status"), F.col("m.at").alias("at"), "first_at", "events")


def live(state: DataFrame, status: str, since: int | None = None) -> DataFrame:
    """Keys whose last status is that one, and not older than a retention limit."""
    rows = state.where(F.col("status") == status)
    return rows if since is None else rows.where(F.col("at") >= since)


def target(spark: SparkSession, path: str) -> Target:
    return Target(spark, path, STATE, ["key"])


def keep_up(events: DataFrame, state: Target, checkpoint: str, available_now: bool = True):
    """A streaming query that folds a stream of events into the state, which latest() reads."""

    def merge(batch: DataFrame, _: int) -> None:
        state.upsert(lambda rows: fold_events(rows, batch), batch.where("key is not null"))

    writer = events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windows(events: DataFrame, at: str, size: str, late: str, by: str) -> DataFrame:
    """Counts in tumbling windows of event time; events later than the watermark are left out when streaming."""
    return events.withWatermark(at, late).groupBy(F.window(at, size), by).agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), by, "events")


def batch_state(events: DataFrame) -> DataFrame:
    """The same state from the whole log at once."""
    good = events.where("key is not null and at is not null").select("key", "status", "at").distinct()
    first = good.groupBy("key").agg(F.min("at").alias("first_at"), F.count("*").alias("events"))
    return last_wins(good, ["key"], F.col("at"), F.col("status")).join(first, "key").select(*STATE.fieldNames())
