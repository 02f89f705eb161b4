"""How many people a text says that an organisation employs.

Patterns are tried in their order; the first that is found holds. A number with spaces or dots between groups of three
is one number, a decimal part is dropped, and a number that can only be a year is none. A text that says there is nobody
counts as 0. Texts that name two different numbers by the same pattern are in conflict and give no count. Null: null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"(\d{1,3}(?:[ .]\d{3})+|\d{1,6})(?:,\d+)?"
#: Name and pattern of each measure, in the order in which they are tried; the number is the first group.
PATTERNS = {
    "average": rf"(?:gjennomsnittlig antall|gjennomsnittleg tal på|average number of) (?:ansatte|tilsette|employees)(?:\D{{0,30}}?(?:19|20)\d\d)?\D{{0,30}}?{NUMBER}",
    "employees": rf"(?:har|hadde|employs|sysselsetter|sysselset)\s+{NUMBER}\s+(?:ansatte|tilsette|medarbeidere|medarbeidarar|employees|people)",
    "man_years": rf"{NUMBER}\s+årsverk",
    "total": rf"(?:totalt|i alt|in all)\s+{NUMBER}\s+(?:ansatte|tilsette|employees)",
}
NOBODY = r"\b(?:ingen (?:ansatte|tilsette)|no employees|har ikke ansatte|har ikkje tilsette)\b"


def workforce(text: Column) -> Column:
    """struct(status, measure, count): status is stated, none, conflict or unknown."""
    low = F.lower(text)
    best = F.lit(None).cast("struct<status:string,measure:string,count:int>")
    for measure, pattern in reversed(PATTERNS.items()):
        numbers = F.transform(F.regexp_extract_all(low, F.lit(pattern), 1), lambda x: F.regexp_replace(x, "[ .]", "").cast("int"))
        real = F.array_distinct(F.filter(numbers, lambda n: ~n.between(1900, 2100)))
        found = F.struct(F.when(F.size(real) > 1, "conflict").otherwise("stated").alias("status"), F.lit(measure).alias("measure"), F.when(F.size(real) == 1, F.get(real, F.lit(0))).alias("count"))
        best = F.when(F.size(real) > 0, found).otherwise(best)
    nobody = F.struct(F.lit("none").alias("status"), F.lit("nobody").alias("measure"), F.lit(0).alias("count"))
    unknown = F.struct(F.lit("unknown").alias("status"), F.lit(None).cast("string").alias("measure"), F.lit(None).cast("int").alias("count"))
    return F.when(text.isNull(), F.lit(None)).otherwise(F.coalesce(best, F.when(low.rlike(NOBODY), nobody), unknown))
