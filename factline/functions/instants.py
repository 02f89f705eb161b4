"""Instants and dates in several spellings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(value: Column) -> Column:
    """A timestamp from ISO 8601 text with any offset (none: UTC) or from milliseconds since 1970; else null."""
    text = F.trim(value)
    iso = F.when(text.rlike(r"(Z|z|[+-]\d{2}(:?\d{2})?)$") & text.contains(":"), text).when(
        text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.concat(text, F.when(text.contains(":"), F.lit("Z")).otherwise(F.lit("T00:00:00Z")))
    )
    return F.when(text.rlike(r"^-?\d{9,15}$"), F.timestamp_millis(F.expr("0L") + text.try_cast("long"))).otherwise(iso.try_cast("timestamp"))


def written_date(value: Column) -> Column:
    """yyyy-MM-dd as written (no shift by an offset) from ISO text or from dd.MM.yyyy; else null."""
    text = F.trim(value)
    iso = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1)
    parts = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})"
    dotted = F.concat_ws("-", F.regexp_extract(text, parts, 3), F.lpad(F.regexp_extract(text, parts, 2), 2, "0"), F.lpad(F.regexp_extract(text, parts, 1), 2, "0"))
    return F.when(iso != "", iso).when(text.rlike(parts), dotted)
