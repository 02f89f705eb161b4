"""Readers of key lists, bulk files, feeds and labels: files in, typed DataFrames out. Nothing is inferred or fetched."""

from __future__ import annotations

import gzip
import os
from collections.abc import Sequence
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import digits
from ..runtime import work_path

GZIP_MAGIC = b"\x1f\x8b"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value and position of each line; positions follow the order in the files."""
    return spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value"), F.monotonically_increasing_id().alias("position"))


def key_list(spark: SparkSession, path: str, checked: bool = True) -> DataFrame:
    """organisation_number and position from lines of text, of JSON rows, or a JSON list; a byte order mark is allowed.

    checked keeps only numbers of nine digits, each once where it was first; raises ValueError if there is none.
    """
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("v"))
    head = F.substring(F.ltrim("v"), 1, 1)
    listed = F.coalesce(F.from_json("v", "array<string>"), F.from_json("v", "organisation_numbers array<string>")["organisation_numbers"])
    is_list = (head == "[") | ((head == "{") & listed.isNotNull())
    rows = F.split("v", r"\r?\n")
    of_row = lambda r: F.when(F.ltrim(r).startswith("{"), F.get_json_object(r, "$.organisation_number")).otherwise(r)
    keys = whole.select(F.posexplode(F.when(is_list, listed).otherwise(F.transform(rows, of_row))).alias("position", "organisation_number"))
    if not checked:
        return keys.where(F.trim("organisation_number") != "").select(F.trim("organisation_number").alias("organisation_number"), "position")
    found = keys.select(digits(F.col("organisation_number")).alias("organisation_number"), "position").where(F.length("organisation_number") == 9)
    found = found.groupBy("organisation_number").agg(F.min("position").alias("position"))
    if found.isEmpty():
        raise ValueError(f"no organisation number in {path}")
    return found


def is_gzip(path: str) -> bool:
    """Whether a local file is gzip by its first bytes, whatever its name."""
    with open(path, "rb") as f:
        return f.read(2) == GZIP_MAGIC


def bulk_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, local: bool = False, multi_line: bool = False) -> DataFrame:
    """A bulk register file with every column as text; names may hold dots and are matched in any case.

    Plain files are read in parts, as no value of the register holds a line break; multi_line reads files that have such
    values, each in one task. Spark takes the codec from the extension, so a local gzip file under another name is linked
    in the shared folder under one that ends in .gz. Columns that the file lacks are null.
    """
    if local and is_gzip(path) and not path.endswith(".gz"):
        folder = urlparse(work_path(spark, "bulk"))
        if folder.scheme not in ("", "file"):
            raise ValueError("a file under another name than .gz can be linked on a local or mounted file system only")
        os.makedirs(folder.path)
        link = os.path.join(folder.path, "bulk.csv.gz")
        os.symlink(os.path.abspath(path), link)
        path = f"file://{link}"
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, quote='"', escape='"')
    if columns is None:
        return rows
    have = {c.lower(): c for c in rows.columns}
    return rows.select(*[(F.col(f"`{have[c.lower()]}`") if c.lower() in have else F.lit(None).cast("string")).alias(c) for c in columns])


def bulk_ok(path: str, header: str = "organisasjonsnummer") -> bool:
    """Whether a local bulk file can be read to its end and its head names the key."""
    try:
        opener = gzip.open if is_gzip(path) else open
        with opener(path, "rt", encoding="utf-8-sig") as f:
            if header not in f.readline():
                return False
            while f.read(1 << 20):
                pass
        return True
    except (OSError, EOFError, UnicodeDecodeError):
        return False


def typed(value: Column, kind: str) -> Column:
    """A bulk text as int (digits only), double or boolean (the text true); blank and unreadable are null."""
    v = F.nullif(F.trim(value), F.lit(""))
    return F.lower(v) == "true" if kind == "boolean" else v.try_cast(kind)


def json_rows(spark: SparkSession, path: str, schema: T.StructType | str, missing_ok: bool = True) -> DataFrame:
    """JSON lines of a schema; lines that aren't JSON drop out. A missing path is an empty table, or an error."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at):
        if not missing_ok:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = spark.read.text(path).where(F.trim("value") != "").select(parsed.alias("r"))
    return rows.where("r is not null and r._bad is null").select(*[F.col(f"r.{n}").alias(n) for n in schema.fieldNames()])


def position_rows(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Lines that are JSON lists, as columns by position, text or JSON; shorter lists leave nulls."""
    got = _lines(spark, path).select(F.from_json("value", "array<variant>").alias("a"), "position").where("a is not null")
    text = lambda i: F.coalesce(F.try_variant_get(F.get("a", F.lit(i)), "$", "string"), F.to_json(F.get("a", F.lit(i))))
    return got.select(*[F.nullif(text(i), F.lit("null")).alias(n) for i, n in enumerate(names)], "position")


def labels(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str, key: str = "organisation_number") -> DataFrame:
    """Labels of several files; the later file, and in it the later line, wins for each key."""
    parts = [json_rows(spark, p, schema).withColumn("_file", F.lit(i)).withColumn("_line", F.monotonically_increasing_id()) for i, p in enumerate(paths)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("_file", "_line")).alias("b"))
    return best.select(key, *[F.col(f"b.{c}").alias(c) for c in rest if not c.startswith("_")])


FEED_PAGE = "id string, next_id string, items array<struct<id:string,url:string,title:string,date_modified:string,_feed_entry:struct<uuid:string,status:string,title:string,businessName:string,municipal:string,sistEndret:string>>>"


def feed_events(pages: DataFrame) -> DataFrame:
    """One row for each item of feed pages (JSON text in value, order in position), in the order of the feed.

    Pages that were read twice give each event once.
    """
    items = pages.select("position", F.from_json("value", FEED_PAGE).alias("p")).select("position", F.posexplode("p.items").alias("place", "i"))
    e = F.col("i._feed_entry")
    rows = items.select(
        e["uuid"].alias("uuid"), e["status"].alias("status"), F.coalesce(e["title"], F.col("i.title")).alias("title"), e["businessName"].alias("business_name"), e["municipal"].alias("municipal"),
        F.coalesce(F.col("i.date_modified"), e["sistEndret"]).alias("modified"), F.struct("position", "place").alias("seq"),
    )
    return rows.where("uuid is not null").dropDuplicates(["uuid", "modified", "status"])


def bindings(text: Column) -> Column:
    """Rows of a knowledge-base answer: an array of maps from variable to value."""
    rows = F.from_json(text, "results struct<bindings:array<map<string,struct<value:string>>>>")["results"]["bindings"]
    return F.transform(rows, lambda r: F.transform_values(r, lambda _, v: v["value"]))


def wordpress_posts(text: Column) -> Column:
    rows = F.from_json(text, "array<struct<date:string,link:string,title:struct<rendered:string>>>")
    return F.transform(F.filter(rows, lambda p: p["link"].isNotNull()), lambda p: F.struct(p["title"]["rendered"].alias("title"), p["link"].alias("url"), F.substring(p["date"], 1, 10).alias("published")))


def job_postings(text: Column, provider: str) -> Column:
    """title, url and published of an applicant system's answer: greenhouse, lever or smartrecruiters."""
    if provider == "greenhouse":
        rows = F.from_json(text, "jobs array<struct<absolute_url:string,title:string,first_published:string,updated_at:string>>")["jobs"]
        return F.transform(rows, lambda j: F.struct(j["title"].alias("title"), j["absolute_url"].alias("url"), F.substring(F.coalesce(j["first_published"], j["updated_at"]), 1, 10).alias("published")))
    if provider == "lever":
        rows = F.from_json(text, "array<struct<text:string,hostedUrl:string,createdAt:long>>")
        return F.transform(rows, lambda j: F.struct(j["text"].alias("title"), j["hostedUrl"].alias("url"), F.to_date(F.timestamp_millis(j["createdAt"])).cast("string").alias("published")))
    if provider == "smartrecruiters":
        rows = F.from_json(text, "content array<struct<name:string,ref:string,releasedDate:string>>")["content"]
        return F.transform(rows, lambda j: F.struct(j["name"].alias("title"), j["ref"].alias("url"), F.substring(j["releasedDate"], 1, 10).alias("published")))
    raise ValueError(f"no provider {provider!r}")


def search_results(text: Column) -> Column:
    """Addresses of a search answer in any of three shapes."""
    url = lambda r: F.coalesce(r["url"], r["link"])
    shape = "array<struct<url:string,link:string>>"
    a = F.from_json(text, f"web struct<results:{shape}>")["web"]["results"]
    b = F.from_json(text, f"organic {shape}")["organic"]
    c = F.from_json(text, f"results {shape}")["results"]
    return F.transform(F.coalesce(a, b, c), url)
