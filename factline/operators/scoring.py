"""Scores of runs: rates by part, points with gates, and what a profile holds.

Empty parts have the rate null, which earns its points only where the caller says so. Nulls don't count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(hits: Column, all_: Column, digits: int = 4) -> Column:
    """hits / all, half-even; null where there is nothing."""
    return F.when(all_ > 0, F.bround(hits / all_, digits))


def points(parts: Sequence[tuple[Column, float]], gates: Sequence[Column], cap: float = 40.0) -> Column:
    """The sum of rates times their points (null rates count nothing), at most cap if any gate is shut."""
    total = sum((F.coalesce(r, F.lit(0.0)) * F.lit(p) for r, p in parts), F.lit(0.0))
    shut = F.lit(False)
    for g in gates:
        shut = shut | ~F.coalesce(g, F.lit(False))
    return F.bround(F.when(shut, F.least(total, F.lit(cap))).otherwise(total), 2)


def first_available(fields: Column, names: Sequence[str]) -> Column:
    """The first value in a map of fields by the order of names; null if none is there."""
    return F.coalesce(*[F.get(F.array(fields[n]), F.lit(0)) for n in names])
