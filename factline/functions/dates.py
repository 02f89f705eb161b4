"""Dates in the spellings of feeds and pages, as Column expressions; unreadable ones are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of months, Norwegian and English, with their numbers.
MONTHS = {
    "januar": 1, "februar": 2, "mars": 3, "april": 4, "mai": 5, "juni": 6, "juli": 7, "august": 8, "september": 9, "oktober": 10, "november": 11, "desember": 12,
    "january": 1, "february": 2, "march": 3, "may": 5, "june": 6, "july": 7, "october": 10, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "okt": 10, "oct": 10, "nov": 11, "des": 12, "dec": 12,
}


def _month(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv]), name)


def _made(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")).try_cast("date").cast("string")


def feed_date(text: Column) -> Column:
    """yyyy-MM-dd from RFC 822 or a leading ISO date."""
    rfc = F.try_to_timestamp(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    iso = F.nullif(F.regexp_extract(text, r"^\s*(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    return F.coalesce(iso, F.to_date(rfc).cast("string"))


def text_date(text: Column) -> Column:
    """The first date written as 5. mars 2024, 5 March 2024, March 5, 2024 or 05.03.2024."""
    low = F.lower(text)
    worded, english, dotted = r"(\d{1,2})\.?\s+([a-zæøå]+)\.?\s+(\d{4})", r"([a-z]+)\s+(\d{1,2}),?\s+(\d{4})", r"(\d{1,2})\.(\d{1,2})\.(\d{4})"
    part = lambda p, i: F.regexp_extract(low, p, i)
    a = F.when(_month(part(worded, 2)).isNotNull(), _made(part(worded, 3), _month(part(worded, 2)), part(worded, 1)))
    b = F.when(_month(part(english, 1)).isNotNull(), _made(part(english, 3), _month(part(english, 1)), part(english, 2)))
    c = F.when(part(dotted, 3) != "", _made(part(dotted, 3), part(dotted, 2), part(dotted, 1)))
    return F.coalesce(a, b, c)


def millis_date(ms: Column) -> Column:
    return F.to_date(F.timestamp_millis(ms)).cast("string")


def utc_text(at: Column) -> Column:
    """ISO with seconds and Z."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def within_days(at: Column, now: Column, days: int) -> Column:
    return F.coalesce((at <= now) & (at >= now - F.make_dt_interval(F.lit(days))), F.lit(False))


def agree(a: Column, b: Column, days: int = 2) -> Column:
    return F.coalesce(F.abs(F.datediff(a.try_cast("date"), b.try_cast("date"))) <= days, F.lit(False))


def years_since(date: Column, now: Column) -> Column:
    """Whole years, by month and day."""
    a, b = date.try_cast("date"), now.try_cast("date")
    return F.year(b) - F.year(a) - ((F.month(b) * 100 + F.dayofmonth(b)) < (F.month(a) * 100 + F.dayofmonth(a))).cast("int")


def time_slices(start: Column, end: Column, n: int) -> Column:
    """n + 1 boundaries of equal parts of a window."""
    a, b = F.unix_millis(start), F.unix_millis(end)
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.timestamp_millis(F.floor(a + (b - a) * i / n)))
