"""Queries of the general problems, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import types as T

from ..operators import history, incremental, nested, snapshot_diff
from ..runtime import work_path
from ..sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Each organisation's names with the periods in which they were valid."""
    return history.name_history(table(spark, d, "register_entity"))


def p1_attribute_versions(spark: SparkSession, d: str) -> DataFrame:
    """Versions of an organisation's address, industry, staff and bankruptcy, by snapshot differencing."""
    rows = table(spark, d, "register_entity").where("status = 200").select(
        F.col("body.organisasjonsnummer").alias("organisation_number"), "snapshot_date", "retrieved_at",
        F.col("body.postadresse.postnummer").alias("postcode"), F.col("body.naeringskode1.kode").alias("industry"),
        F.col("body.antallAnsatte").alias("employees"), F.col("body.konkurs").alias("bankrupt"),
    )
    out = history.attribute_history(rows, ["organisation_number"], "snapshot_date", "retrieved_at", ["postcode", "industry", "employees", "bankrupt"])
    return out.withColumn("valid_from", F.col("valid_from").cast("string")).withColumn("valid_to", F.col("valid_to").cast("string"))


AD_STATE = T.StructType([T.StructField("uuid", T.StringType()), T.StructField("sist_endret_ms", T.LongType())])


def ad_feed(spark: SparkSession, d: str, state: str | None = None) -> tuple[incremental.Target, DataFrame]:
    """The target of the feed's runs, and the deliveries that the next run finds, as versions.

    state is the target's folder, which outlives the session; where it has no version yet, its first one is what the
    successful runs have processed: the versions delivered up to the cursors. Without a folder it is one of the session.
    """
    target = incremental.Target(spark, state or work_path(spark, "ads"), AD_STATE, ["uuid", "sist_endret_ms"])
    versions = incremental.ad_versions(table(spark, d, "active_ads"))
    done, found = incremental.split_by_cursor(versions, incremental.slice_cursors(table(spark, d, "nav_feed_cursor")))
    if not target.version():
        target.publish(done, 0)
    return target, found


def p2_found(spark: SparkSession, d: str, state: str | None = None) -> DataFrame:
    """The ad versions that the next feed run has to process: those found after the cursors that the target lacks."""
    target, found = ad_feed(spark, d, state)
    return incremental.pending(found, target.read(), target.keys)


def p2_after_run(spark: SparkSession, d: str, state: str | None = None) -> DataFrame:
    """Versions in the target after the next run, and what a further run would still find: nothing."""
    target, found = ad_feed(spark, d, state)
    target.run(found, lambda new: new)
    held = target.read()
    left = incremental.pending(found, held, target.keys)
    count = [F.count("*").alias("versions"), F.countDistinct("uuid").alias("ads")]
    return held.agg(*count).withColumn("part", F.lit("held")).unionByName(left.agg(*count).withColumn("part", F.lit("left over")))


def _has(name: str) -> Column:
    """Whether a content's member of that name isn't null."""
    return F.get_json_object("content", f"$.{name}").isNotNull()


def _accounts(spark: SparkSession, d: str) -> nested.Shredded:
    rows = table(spark, d, "register_accounts").where("status = 200")
    return nested.shred(nested.latest_body(rows, "organisation_number", "retrieved_at", "body"), "key", "body", "accounts")


def _roles(spark: SparkSession, d: str) -> nested.Shredded:
    rows = table(spark, d, "register_roles").where("status = 200")
    return nested.shred(nested.latest_body(rows, "organisation_number", "retrieved_at", "body"), "key", "body", "roles")


def _feed(spark: SparkSession, d: str) -> nested.Shredded:
    return nested.shred(nested.latest_body(table(spark, d, "feed_entry"), "uuid", "retrieved_at", "ad_content"), "key", "body", "feed")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Accounts, roles and work locations as flat rows with their parent's key and their places in its body."""
    none = F.lit(-1)
    t = _accounts(spark, d)
    one = t.under(t.under(t.roots, "root", "", "account", "pos_1"), "account", "egenkapitalGjeld", "sheet")
    one = t.content(one, "sheet", "content", _has("sumEgenkapitalGjeld"))
    accounts = one.select(F.lit("account").alias("child"), F.col("key").alias("parent_key"), "pos_1", none.alias("pos_2"))
    t = _roles(spark, d)
    group = t.content(t.under(t.roots, "root", "rollegrupper", "group", "pos_1"), "group", "content", _has("sistEndret"))
    role = t.content(t.under(group.drop("content"), "group", "roller", "role", "pos_2"), "role", "content", F.col("kind") != "null")
    roles = role.select(F.lit("role").alias("child"), F.col("key").alias("parent_key"), "pos_1", "pos_2")
    t = _feed(spark, d)
    place = t.content(t.under(t.roots, "root", "workLocations", "place", "pos_1"), "place", "content", F.get_json_object("content", "$.city").rlike(r"(?U)\S"))
    places = place.select(F.lit("work_location").alias("child"), F.col("key").alias("parent_key"), "pos_1", none.alias("pos_2"))
    return accounts.unionByName(roles).unionByName(places)


def p4_identities(spark: SparkSession, d: str) -> DataFrame:
    """How often the role register's identical objects occur, and how many are stored."""
    t = _roles(spark, d)
    uses = t.bridge.where("child is not null").groupBy(F.col("child").alias("hash")).agg(F.count("*").alias("parents"))
    return t.objects.join(uses, "hash", "left").groupBy("kind").agg(F.count("*").alias("stored"), F.sum(F.coalesce("parents", F.lit(0))).alias("links"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Claims added, removed or changed between consecutive snapshots."""
    claims = table(spark, d, "claims")
    keys = {"organisation_number": F.col("organisation_number"), "family": F.col("family"), "field": F.col("field"), "value_key": F.coalesce("value_key", F.lit(""))}
    period = F.col("reporting_period")
    values = [snapshot_diff.canonical_json(F.col("value"), ["checked_at"]), period["start"], period["end"], F.col("effective_date"), F.col("availability"), F.col("status")]
    out = snapshot_diff.changes(claims, "snapshot_no", keys, values, "last_observed_at")
    return out.withColumnRenamed("snapshot", "snapshot_no")


QUERIES = {
    "p1_found": p1_found,
    "p1_attribute_versions": p1_attribute_versions,
    "p2_found": p2_found,
    "p2_after_run": p2_after_run,
    "p4_found": p4_found,
    "p4_identities": p4_identities,
    "p5_found": p5_found,
}
