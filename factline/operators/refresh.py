"""Comparison of a run's claims with the previous run's: typed changes, claims carried forward, history.

Claims are rows with org, family, field, value_key, value (canonical JSON), period_start, period_end, status. The two runs
meet in one full outer join on the claim's identity, and every rule is an expression over the joined row.

Nulls: a null value_key and '' are one identity, whose single value may change; others are items that come and go.
Repeats: one row for each identity is expected (see operators.choosing). Skew: the join is on the whole identity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys, text

# Types of changes by family.
NEW_ITEM = {"leadership": "new_role", "jobs": "new_job", "locations": "new_location", "profiles": "new_profile", "activity": "new_activity"}
ENDED_ITEM = {"leadership": "ended_role", "jobs": "closed_job", "locations": "closed_location", "profiles": "removed_profile"}
CHANGED = {"website": "changed_website", "description": "changed_description", "identity": "identity_changed", "financials": "new_filing", "financial_history": "new_filing"}
FINANCIAL = ("financials", "financial_history")
MULTI = tuple(NEW_ITEM)
CHECKED = ("available", "not_available", "not_applicable")
UNCHECKED_REASONS = ("deadline", "request_budget")
CARRIED = "carried forward: source not re-checked"
ID = ["org", "family", "field", "value_key"]
REST = ["value", "period_start", "period_end"]


def _of(column: Column, table: dict[str, str], other: Column | None = None) -> Column:
    out = other if other is not None else F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def current(claims: DataFrame) -> DataFrame:
    """Claims with status current, their value_key never null."""
    return claims.where("status = 'current'").withColumn("value_key", F.coalesce("value_key", F.lit("")))


def meet(before: DataFrame, after: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Both runs' current claims side by side, as prev_ and curr_ columns; by: columns that tell several comparisons apart."""
    p = current(before).select(*by, *ID, F.lit(True).alias("prev"), *[F.col(c).alias(f"prev_{c}") for c in REST])
    c = current(after).select(*by, *ID, F.lit(True).alias("curr"), *[F.col(x).alias(f"curr_{x}") for x in REST])
    return p.join(c, [*by, *ID], "full_outer").withColumns({k: F.coalesce(k, F.lit(False)) for k in ("prev", "curr")})


def checked(availability: Column, reason: Column) -> Column:
    """Whether a family's source was really read in this run; false for a missing state."""
    late = F.lit(False)
    for r in UNCHECKED_REASONS:
        late = late | F.coalesce(reason, F.lit("")).contains(r)
    return F.coalesce(availability.isin(*CHECKED) & ~late, F.lit(False))


def _equal() -> Column:
    site = text.site_key(F.coalesce(F.get_json_object("prev_value", "$.url"), F.get_json_object("prev_value", "$"))).eqNullSafe(
        text.site_key(F.coalesce(F.get_json_object("curr_value", "$.url"), F.get_json_object("curr_value", "$")))
    )
    same = F.col("prev_value").eqNullSafe(F.col("curr_value")) & F.col("prev_period_start").eqNullSafe(F.col("curr_period_start")) & F.col("prev_period_end").eqNullSafe(F.col("curr_period_end"))
    words = (F.col("family") == "description") & text.plain_text(F.get_json_object("prev_value", "$")).eqNullSafe(text.plain_text(F.get_json_object("curr_value", "$")))
    return F.when(F.col("field") == "official_website", site).otherwise(same | words)


def changes(before: DataFrame, after: DataFrame, states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, org, family, field, value_key, change_type, prev_value, curr_value, change_id of each change.

    states: org, family, checked. What a source that wasn't read leaves out hasn't changed.
    """
    item = F.col("value_key") != ""
    advanced = F.coalesce(F.col("curr_period_end") > F.coalesce("prev_period_end", F.lit("")), F.lit(False))
    mapped = _of(F.col("family"), CHANGED, F.lit("changed_value"))
    differs = F.when(F.col("family").isin(*FINANCIAL) & ~advanced, F.lit("changed_value")).otherwise(mapped)
    kind = (
        F.when(F.col("prev") & F.col("curr"), F.when(~_equal(), differs))
        .when(F.col("curr"), F.when(item, _of(F.col("family"), NEW_ITEM)).otherwise(mapped))
        .when((F.col("family") == "activity") | ~F.col("checked"), F.lit(None).cast("string"))
        .otherwise(F.when(item, _of(F.col("family"), ENDED_ITEM)).otherwise(mapped))
    )
    both = meet(before, after, by).join(states.select(*by, "org", "family", "checked"), [*by, "org", "family"], "left").withColumn("checked", F.coalesce("checked", F.lit(False)))
    out = both.withColumn("change_type", kind).where("change_type is not null")
    claim = keys.claim_id(*[F.col(c) for c in ID])
    return out.select(*by, *ID, "change_type", "prev_value", "curr_value", keys.change_id(claim, F.col("change_type"), F.col("prev_value"), F.col("curr_value")).alias("change_id"))


def merged(before: DataFrame, after: DataFrame, states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The state after a run: by, identity, value, origin and note.

    origin is new, kept, superseded (a new value; the old one goes to history), carried (not seen, source not read),
    withdrawn (activity not seen) or ended (not seen, source read).
    """
    both = meet(before, after, by).join(states.select(*by, "org", "family", "checked"), [*by, "org", "family"], "left").withColumn("checked", F.coalesce("checked", F.lit(False)))
    gone = F.when(~F.col("checked"), "carried").when(F.col("family") == "activity", "withdrawn").otherwise("ended")
    origin = F.when(F.col("prev") & F.col("curr"), F.when(_equal(), "kept").otherwise("superseded")).when(F.col("curr"), "new").otherwise(gone)
    out = both.withColumn("origin", origin)
    return out.select(*by, *ID, F.when(F.col("curr"), F.col("curr_value")).otherwise(F.col("prev_value")).alias("value"), "origin", F.when(F.col("origin") == "carried", CARRIED).alias("note"))
