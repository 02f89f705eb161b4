"""Reading of the parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..runtime import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table of that name; column pruning and filters reach the parquet scan. Workers get the package with the first."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def files_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The same table as a stream of its files, new ones as they come; a table may be one file or a folder of files."""
    path = f"{folder}/{name}.parquet"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
