"""Queries of the language-model data problems and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import bpe, linkage, mainbody, mixture, visual


def _links(spark: SparkSession, d: str) -> DataFrame:
    names = ("active_ads", "place", "osm", "postal_place")
    return linkage.link(*linkage.establishment_rows(*[table(spark, d, n) for n in names]))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of ads, places and map features of the same establishment."""
    return _links(spark, d).select("key_1", "key_2")


def p3_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The pairs with the confidence of each."""
    return _links(spark, d)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each page's main body."""
    return mainbody.main_body(table(spark, d, "page_fetch"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of each document by byte_bpe_50k."""
    return bpe.encode(table(spark, d, "documents"))


def _mixture(spark: SparkSession, d: str) -> mixture.Mixture:
    return mixture.mix(mixture.sized(table(spark, d, "documents"), table(spark, d, "register_entity")), table(spark, d, "source_weight"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return _mixture(spark, d).documents


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mixture(spark, d).shares()


def p8_margins(spark: SparkSession, d: str) -> DataFrame:
    """Tokens by language and topic, in the corpus and in the mixture."""
    return _mixture(spark, d).margins()


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Whether the fit converged, by how much it misses its margins, and which sources' caps bind."""
    return _mixture(spark, d).report()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that look the same while their strings differ."""
    return visual.same_looking(table(spark, d, "documents"))


def p9_forms(spark: SparkSession, d: str) -> DataFrame:
    """Each document's consistent form, as a digest, with its length and whether the text was in it already."""
    docs = table(spark, d, "documents").select("doc_id", "text").withColumn("form", visual.one_form("text"))
    return docs.select("doc_id", F.md5("form").alias("form"), F.length("form").alias("length"), F.col("form").eqNullSafe(F.col("text")).alias("unchanged"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each look with several spellings, by spelling: its documents, and how many documents of other spellings look the same."""
    return visual.classes_of(table(spark, d, "documents"))[0].where("spellings > 1")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p3_found": p3_found,
        "p3_confidence": p3_confidence,
        "p6_found": p6_found,
        "p7_ids": p7_ids,
        "p8_mixture": p8_mixture,
        "p8_shares": p8_shares,
        "p8_margins": p8_margins,
        "p8_report": p8_report,
        "p9_found": p9_found,
        "p9_forms": p9_forms,
        "p9_classes": p9_classes,
    }


def oracle_sql() -> dict[str, str]:
    return {}
