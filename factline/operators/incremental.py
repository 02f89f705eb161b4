"""Processing of new or changed records only, with the target itself as the state.

Every output row keeps the source key and the version that it came from. A run anti-joins the source's versions
against those in the current target, processes what is left, and publishes only the new rows, as a segment of their
own: the segment is written to a folder that no other run can name, then a manifest that lists the old segments and
the new one is put in place under the next version's number. Putting it in place is one step that at most one run can
do for a number, and nothing that has been published is ever deleted or written to by a run. A run that fails before
that step leaves the target as it was, so the next run processes the same versions; a run after it finds them in the
target and processes none of them again. A run that was overtaken raises, and its rows are pending still.

Cost of a run: its new rows are written, and of the target only the key columns are read. ``compact`` puts the segments
together, ``vacuum`` deletes those that no kept manifest lists and that are older than any run can be.

File systems: the step needs a rename that doesn't replace, or a link. Local and mounted file systems have the link,
HDFS and its views the rename. Object stores have neither; a target there raises ValueError.

Nulls: source rows without key or version don't count. Repeats: a version delivered several times is one. An empty
source or target is an ordinary case. Extra columns pass through; the columns added are named by the caller.
Skew: deliveries are reduced to one row for each key and version by map-side aggregation before any join.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Sequence
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.instants import instant
from ..runtime import bounded_broadcast, remove_path

#: Schemes of file systems whose rename refuses to replace a file, in one step.
RENAMES = ("hdfs", "viewfs", "webhdfs")
#: Segments of a target before a run of ``upsert`` puts them together.
SEGMENTS = 32
#: The column of a row's version in the target.
VERSION = "_version"


def pending(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of source whose keys (source key and version) the target doesn't hold."""
    held = target.select(*keys).distinct()
    return source.join(held, list(keys), "left_anti")


class Target:
    """A table in versions under one folder; readers see the version that was published last."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, list(keys)
        self._stored = T.StructType([*schema.fields, T.StructField(VERSION, T.LongType())])
        self._at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.scheme = str(self._fs.getScheme())
        if self.scheme != "file" and self.scheme not in RENAMES:
            raise ValueError(f"{self.scheme} has no step that publishes a version at most once")

    def _numbers(self) -> list[int]:
        folder = self._at(f"{self.path}/_published")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def version(self) -> int:
        """The number of the published version; 0 before the first."""
        return max(self._numbers(), default=0)

    def segments(self, version: int | None = None) -> list[str]:
        """The folders of the segments of a version, the published one if none is given."""
        n = self.version() if version is None else version
        if not n:
            return []
        stream = self._fs.open(self._at(f"{self.path}/_published/{n}"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)["segments"]

    def _rows(self, version: int | None = None) -> DataFrame:
        found = self.segments(version)
        if not found:
            return self.spark.createDataFrame([], self._stored)
        return self.spark.read.schema(self._stored).parquet(*[f"{self.path}/segments/{s}" for s in found])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the published version, or of an earlier one that hasn't been vacuumed."""
        return self._rows(version).drop(VERSION)

    def latest(self, version: int | None = None) -> DataFrame:
        """One row for each key: that of the last version which wrote it."""
        others = [c for c in self.schema.fieldNames() if c not in self.keys]
        best = self._rows(version).groupBy(*self.keys).agg(F.max_by(F.struct(*others), VERSION).alias("_m"))
        return best.select(*[F.col(c) if c in self.keys else F.col(f"_m.{c}").alias(c) for c in self.schema.fieldNames()])

    def stage(self, rows: DataFrame, version: int) -> str:
        """Write rows as a segment that nobody sees yet."""
        name = f"{version}-{uuid.uuid4().hex}"
        rows.select(*self.schema.fieldNames(), F.lit(version).cast("long").alias(VERSION)).write.option("compression", "zstd").parquet(f"{self.path}/segments/{name}")
        return name

    def propose(self, segments: Sequence[str], version: int) -> str:
        """Write a manifest of segments that nobody sees yet."""
        path = f"{self.path}/_proposed/{version}-{uuid.uuid4().hex}"
        out = self._fs.create(self._at(path), False)
        out.write(bytearray(json.dumps({"version": version, "segments": list(segments)}).encode()))
        out.close()
        return path

    def commit(self, proposed: str, version: int) -> None:
        """Put a manifest in place as that version; RuntimeError if the version is there already."""
        mark = f"{self.path}/_published/{version}"
        self._fs.mkdirs(self._at(f"{self.path}/_published"))
        if self.scheme == "file":
            try:
                os.link(*[unquote(urlparse(p).path) for p in (proposed, mark)])
                done = True
            except FileExistsError:
                done = False
            self._fs.delete(self._at(proposed), False)
        else:
            done = not self._fs.exists(self._at(mark)) and self._fs.rename(self._at(proposed), self._at(mark))
        if not done:
            raise RuntimeError(f"version {version} was published by another run")

    def publish(self, rows: DataFrame, base: int, keep: bool = True) -> int:
        """Add rows to those of the version base, or replace them if keep is false, and make it the current version.

        Raises RuntimeError if another run has published since base was read; the table is then as that run left it.
        """
        n = base + 1
        segment = self.stage(rows, n)
        try:
            self.commit(self.propose([*(self.segments(base) if keep else []), segment], n), n)
        except RuntimeError:
            remove_path(self.spark, f"{self.path}/segments/{segment}")
            raise
        return n

    def run(self, source: DataFrame, process: Callable[[DataFrame], DataFrame]) -> int:
        """Process what the target lacks and add it to the target; process keeps the key columns."""
        base = self.version()
        new = process(pending(source, self.read(base), self.keys)).select(*self.schema.fieldNames())
        return self.publish(new, base)

    def upsert(self, change: Callable[[DataFrame], DataFrame], keys: DataFrame) -> int:
        """Publish the new rows that change makes of the present rows of some keys; ``latest`` reads them.

        Only rows of those keys are read out and written, but for every SEGMENTS-th run, which puts segments together.
        """
        base = self.version()
        wanted = bounded_broadcast(keys.select(*self.keys).distinct())
        present = self._rows(base).join(wanted, self.keys, "left_semi")
        others = [c for c in self.schema.fieldNames() if c not in self.keys]
        best = present.groupBy(*self.keys).agg(F.max_by(F.struct(*others), VERSION).alias("_m"))
        best = best.select(*[F.col(c) if c in self.keys else F.col(f"_m.{c}").alias(c) for c in self.schema.fieldNames()])
        n = self.publish(change(best), base)
        return self.publish(self.latest(n), n, keep=False) if len(self.segments(n)) >= SEGMENTS else n

    def compact(self) -> int:
        """Publish the same rows as one segment."""
        base = self.version()
        return self.publish(self.read(base), base, keep=False)

    def vacuum(self, keep: int = 2, older_ms: int = 7 * 24 * 3600 * 1000) -> list[str]:
        """Delete segments that the last keep manifests don't list and that are older than any run under way can be."""
        numbers = self._numbers()
        used = {s for n in numbers[-max(1, keep) :] for s in self.segments(n)}
        folder, gone = self._at(f"{self.path}/segments"), []
        now = self.spark.sparkContext._jvm.java.lang.System.currentTimeMillis()
        for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            if s.getPath().getName() not in used and now - s.getModificationTime() >= older_ms:
                gone.append(s.getPath().getName())
                self._fs.delete(s.getPath(), True)
        for n in numbers[: -max(1, keep)]:
            self._fs.delete(self._at(f"{self.path}/_published/{n}"), False)
        return gone


def ad_versions(ads: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows with the instants parsed; those without sist_endret or updated_at don't count."""
    out = ads.select("uuid", "feed_slice", instant(F.col("sist_endret")).alias("_source"), instant(F.col("updated_at")).alias("delivered"), *by)
    out = out.where("uuid is not null and _source is not null and delivered is not null")
    return out.withColumn("sist_endret_ms", F.unix_millis("_source")).drop("_source")


def slice_cursors(cursors: DataFrame) -> DataFrame:
    """feed_slice and cursor: the value of the highest run that succeeded; a null or unreadable value is none."""
    rows = cursors.where("run_status = 'success'").select(F.regexp_extract("key", r"^slice-(\d+)$", 1).try_cast("int").alias("feed_slice"), "run_id", "written_at", instant(F.col("value")).alias("cursor"))
    rows = rows.where("feed_slice is not null and cursor is not null")
    return rows.groupBy("feed_slice").agg(F.max(F.struct("run_id", "written_at", "cursor")).alias("b")).select("feed_slice", F.col("b.cursor").alias("cursor"))


def split_by_cursor(versions: DataFrame, cursors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The versions of which a delivery lies at or before its slice's cursor, and those of which one lies after it.

    Each has one row for each uuid and version; a version may be in both. A slice without cursor has never run: all
    its deliveries are after.
    """
    at: Column = F.col("cursor")
    rows = versions.join(bounded_broadcast(cursors), "feed_slice", "left")
    keys = ["uuid", "sist_endret_ms"]
    return rows.where(F.col("delivered") <= at).select(*keys).distinct(), rows.where(at.isNull() | (F.col("delivered") > at)).select(*keys).distinct()
