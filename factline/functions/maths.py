"""Numbers: percentages, bands, shares and nearest-rank percentiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pct_change(before: Column, after: Column) -> Column:
    """Null where before is 0."""
    return (after - before) / F.nullif(F.abs(before), F.lit(0.0)) * 100


def share(part: Column, whole: Column, places: int = 4) -> Column:
    """Half-even, 0 where whole is 0."""
    return F.when(whole > 0, F.bround(part / whole, places)).otherwise(F.lit(0.0))


def size_word(employees: Column, revenue: Column) -> Column:
    """By staff; by revenue where staff is unknown."""
    by_staff = F.when(employees >= 250, "large").when(employees >= 50, "medium-sized").when(employees >= 10, "small").when(employees >= 1, "micro")
    by_money = F.when(revenue >= 500_000_000, "large").when(revenue >= 100_000_000, "medium-sized").when(revenue >= 20_000_000, "small")
    return F.when(employees.isNotNull(), by_staff).otherwise(by_money)


def employee_band(n: Column) -> Column:
    return F.when(n.isNull(), "unknown").when(n <= 0, "0").when(n < 5, "1-4").when(n < 20, "5-19").when(n < 50, "20-49").when(n < 250, "50-249").otherwise("250+")


def equity_band(ratio: Column) -> Column:
    return F.when(ratio >= 40, "strong").when(ratio >= 15, "moderate").when(ratio.isNotNull(), "thin")


def nearest_rank(values: Column, p: float) -> Column:
    """Aggregate: the value at the half-even rounded rank p of n - 1. For groups of any size see operators.stats."""
    ordered = F.array_sort(F.collect_list(values))
    return F.element_at(ordered, (F.bround(F.lit(p) * (F.size(ordered) - 1), 0) + 1).cast("int"))


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Position between low and high; 1 where they are equal."""
    return F.when(high == low, F.lit(1.0)).otherwise((value - low) / (high - low))
