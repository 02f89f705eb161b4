"""Identities of claims, evidence, changes and contacts: prefixes of SHA-256 over joined parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _short(prefix: str, *parts: Column) -> Column:
    text = F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, 20))


def claim_id(org: Column, family: Column, field: Column, value_key: Column) -> Column:
    """Of the claim's identity; a null value_key and '' are one."""
    return _short("c_", org, family, field, value_key)


def evidence_id(url: Column, span: Column) -> Column:
    return _short("e_", url, span)


def change_id(claim: Column, kind: Column, before: Column, after: Column) -> Column:
    """before and after are canonical JSON; null is the text null."""
    return _short("x_", claim, kind, F.coalesce(before, F.lit("null")), F.coalesce(after, F.lit("null")))


def contact_key(kind: str, value: Column) -> Column:
    """One-way key of a phone or mail address."""
    return F.substring(F.sha2(F.concat(F.lit(f"{kind}:"), value), 256), 1, 20)


def index_hash(uuids: Column) -> Column:
    """Of the sorted array, each followed by a line end."""
    return F.sha2(F.array_join(F.transform(F.array_sort(uuids), lambda u: F.concat(u, F.lit("\n"))), ""), 256)
