"""Writers: nested envelopes, content-addressed snapshots, directories and reports. Each replaces its target as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def envelopes(claims: DataFrame, evidence: DataFrame, states: DataFrame, order: Column) -> DataFrame:
    """One nested row for each organisation: its claims in canonical order, evidence by id, and families' states.

    All inputs have org; claims also family, field, value_key, claim_id; evidence has evidence_id; states family.
    """

    def nest(rows: DataFrame, name: str, *by: Column) -> DataFrame:
        rest = [c for c in rows.columns if c != "org"]
        packed = F.array_sort(F.collect_list(F.struct(F.struct(*by).alias("o"), F.struct(*rest).alias("v"))))
        return rows.groupBy("org").agg(F.transform(packed, lambda x: x["v"]).alias(name))

    a = nest(claims, "claims", order, F.col("field"), F.coalesce("value_key", F.lit("")), F.col("claim_id"))
    b = nest(evidence, "evidence", F.col("evidence_id"))
    c = nest(states, "families", F.col("family"))
    return a.join(b, "org", "full_outer").join(c, "org", "full_outer")


def write_json(rows: DataFrame, path: str, order: str | None = None, files: int | None = None) -> None:
    """JSON lines; with order sorted over all files."""
    out = rows.orderBy(order) if order else rows
    if files:
        out = out.coalesce(files)
    out.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def add_snapshots(store: DataFrame, fetched: DataFrame, key: str = "sha256") -> DataFrame:
    """The rows of fetched whose content the store doesn't have, each content once: what is to be appended."""
    return fetched.where(F.col(key).isNotNull()).dropDuplicates([key]).join(store.select(key), key, "left_anti")


def write_csv(rows: DataFrame, path: str) -> None:
    """One file with a header, nulls as nothing."""
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")


def markdown(rows: DataFrame, title: str) -> str:
    """A report's few rows as a table."""
    head = rows.columns
    body = ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.collect()]
    return "\n".join([f"# {title}", "", "| " + " | ".join(head) + " |", "|" + "-|" * len(head), *body, ""])
