"""Session helpers: the folder shared by all executors, materialised tables, size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it has been written and has at most so many rows and characters.
BROADCAST_ROWS = 20_000
BROADCAST_CHARS = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is set, RuntimeError on a cluster, else a folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("factline.shared.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="factline-")
        spark.conf.set("factline.shared.dir", folder)
    return folder.rstrip("/")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each application, wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="factline-code-"), "factline.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)


_kept: set[str] = set()


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; all of an application's go when its driver ends, or with clean_up."""
    folder = f"{shared_dir(spark)}/factline/{spark.sparkContext.applicationId}"
    if folder not in _kept:
        _kept.add(folder)
        atexit.register(clean_up, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex[:12]}"


def clean_up(spark: SparkSession, folder: str | None = None) -> None:
    """Delete the tables that this application has written; DataFrames that read them can't be used after that."""
    for path in [folder] if folder else list(_kept):
        _kept.discard(path)
        try:
            if spark.sparkContext._jsc is not None:
                remove_path(spark, path)
        except Exception:  # noqa: BLE001 - the session is gone already
            continue


def materialize(df: DataFrame, name: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """Write df once to the shared folder and read it back: the lineage ends there, and an executor's loss costs nothing."""
    spark = df.sparkSession
    path = work_path(spark, name)
    writer = df.write.option("compression", "zstd")
    keys = list(partition_by)
    if keys:
        writer = writer.partitionBy(*keys)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_chars: int = BROADCAST_CHARS) -> DataFrame:
    """df, written and with a broadcast hint, if it is that small; else df as it is (Spark then picks a shuffled join).

    Only max_rows + 1 rows are ever written here, and what is broadcast is read from them: df runs once.
    """
    side = materialize(df.limit(max_rows + 1), "side")
    rows, chars = side.agg(F.count("*"), F.sum(F.length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(side) if rows <= max_rows and (chars or 0) <= max_chars else df


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder on the file system of its URI."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
