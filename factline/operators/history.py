"""History of changing attributes, from periodic snapshots.

Consecutive snapshots are compared by a null-safe full outer join, which classifies each key as inserted, changed,
deleted or unchanged; the events are put in order and ``lead`` gives each version its end.

Nulls: rows without key or snapshot are left out; a null attribute is a value like any other. Ties and repeats: of
several rows for one key and snapshot the one with the latest version column holds, then the greatest values. An
empty table gives an empty history. Columns of other names are ignored, so clashing extra columns do no harm.
Skew: rows are first reduced to one for each key and snapshot with map-side aggregation, so a key holds at most as
many rows as there are snapshots, however many copies were delivered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.instants import written_date
from ..runtime import bounded_broadcast


def latest_per_snapshot(rows: DataFrame, keys: Sequence[str], snapshot: str, version: str, attrs: Sequence[str]) -> DataFrame:
    """One row for each key and snapshot: the one with the latest version column."""
    known = rows.where(F.col(snapshot).isNotNull())
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    best = known.groupBy(*keys, snapshot).agg(F.max(F.struct(F.col(version), *[F.col(a) for a in attrs])).alias("_best"))
    return best.select(*keys, snapshot, *[F.col(f"_best.{a}").alias(a) for a in attrs])


def differences(now: DataFrame, keys: Sequence[str], attrs: Sequence[str], compared: Sequence[str]) -> DataFrame:
    """keys, _i (the later snapshot's number), change, attrs and before_<attribute> by one null-safe full outer join.

    now: keys, _i (the number of a row's snapshot; those that follow each other are compared), attrs, and others that are
    kept. change is inserted, changed, deleted or unchanged, by the attributes compared.
    """
    then = now.select(*[F.col(k).alias(f"_k_{k}") for k in keys], (F.col("_i") + 1).alias("_j"), *[F.col(a).alias(f"before_{a}") for a in attrs])
    same_key = F.col("_i") == F.col("_j")
    for k in keys:
        same_key = same_key & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    differs = F.lit(False)
    for a in compared:
        differs = differs | ~F.col(a).eqNullSafe(F.col(f"before_{a}"))
    kind = F.when(F.col("_j").isNull(), "inserted").when(F.col("_i").isNull(), "deleted").when(differs, "changed").otherwise("unchanged")
    both = now.join(then, same_key, "full_outer").withColumn("change", kind)
    here = F.col("_i").isNotNull()
    others = [c for c in now.columns if c not in (*keys, *attrs, "_i")]
    return both.select(*[F.when(here, F.col(k)).otherwise(F.col(f"_k_{k}")).alias(k) for k in keys], *others, F.coalesce("_i", "_j").alias("_i"), "change", *attrs, *[f"before_{a}" for a in attrs])


def snapshot_changes(state: DataFrame, keys: Sequence[str], snapshot: str, attrs: Sequence[str], absent: str = "carry") -> DataFrame:
    """Changes between consecutive snapshots: keys, snapshot, change, the attributes and before_<attribute>.

    state has one row for each key and snapshot. absent="carry": a snapshot that lacks a key says nothing, and the
    key's own snapshots are consecutive. absent="delete": a snapshot that lacks a key deletes it, and all snapshots of
    the table are consecutive. change is inserted, changed, deleted or unchanged.
    """
    cols = [*keys, snapshot, *attrs]
    if absent == "carry":
        now = state.select(*cols).withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy(snapshot)))
        after = None
    else:
        order = state.select(snapshot).distinct().withColumn("_i", F.row_number().over(W.orderBy(snapshot)))
        now = state.select(*cols).join(bounded_broadcast(order), snapshot)
        after = order.select(F.col(snapshot).alias("_after"), (F.col("_i")).alias("_i"))
    out = differences(now, keys, attrs, attrs)
    if after is None:
        return out.where("change <> 'deleted'").drop("_i")
    out = out.join(bounded_broadcast(after), "_i")  # what ends after the last snapshot has no row there: it isn't deleted
    return out.withColumn(snapshot, F.coalesce(snapshot, "_after")).drop("_after", "_i")


def validity(events: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Versions with valid_from and valid_to (null for the present one) from change events in the order of at."""
    w = W.partitionBy(*keys).orderBy(at)
    timed = events.where("change <> 'unchanged'").withColumn("valid_from", F.col(at)).withColumn("valid_to", F.lead(at).over(w))
    return timed.where("change <> 'deleted'")


def attribute_history(rows: DataFrame, keys: Sequence[str], snapshot: str, version: str, attrs: Sequence[str], absent: str = "carry") -> DataFrame:
    """keys, attrs, valid_from, valid_to: each version of the attributes together with its period."""
    state = latest_per_snapshot(rows, keys, snapshot, version, attrs)
    return validity(snapshot_changes(state, keys, snapshot, attrs, absent), keys, snapshot).select(*keys, *attrs, "valid_from", "valid_to")


def clean_name(name: Column) -> Column:
    """Upper case with single spaces, trimmed; '' counts as null."""
    text = F.upper(F.trim(F.regexp_replace(name, r"(?U)\s+", " ")))
    return F.when(text != "", text)


#: The things of a snapshot that name_events compares.
THINGS = "array<struct<kind:int,item:string,day:string,name:string,shows:array<string>,reg:string>>"


def _at(day: Column, kind: Column | int) -> Column:
    """A place on the time line; on one day an end (0) precedes a snapshot (1) and a snapshot a start (2)."""
    return F.struct(day.alias("day"), (F.lit(kind) if isinstance(kind, int) else kind).cast("int").alias("kind"))


def name_events(register: DataFrame) -> DataFrame:
    """Change events of consecutive snapshots: org, change, kind, day, name, before_name, shown, before_shown, shows, reg.

    The things compared are an organisation's present name (kind 1) and each start (2), end (0) or mere mention (-1) of a
    former name; all are rows of one state, so one full outer join classifies them. shown is the snapshot of the row,
    before_shown that of the row before; shows are the organisation's snapshots with a name and reg is its first day,
    both on the first event of its present name.
    """
    rows = register.where("status = 200").select(
        F.col("body.organisasjonsnummer").alias("org"), "snapshot_date", "retrieved_at",
        F.col("body.navn").alias("navn"), F.col("body.registreringsdatoEnhetsregisteret").alias("reg"), F.col("body.historiskeNavn").alias("former"),
    )
    state = latest_per_snapshot(rows, ["org"], "snapshot_date", "retrieved_at", ["navn", "reg", "former"])
    day = F.col("snapshot_date").cast("string")
    state = state.select("org", "snapshot_date", day.alias("shown"), clean_name(F.col("navn")).alias("name"), written_date(F.col("reg")).alias("reg"), "former")
    of = W.partitionBy("org")
    named = F.col("name").isNotNull()
    state = state.withColumn("shows", F.collect_list(F.when(named, F.col("shown"))).over(of)).withColumn("reg", F.min(F.when(named, F.col("reg"))).over(of))
    state = state.withColumn("_i", F.row_number().over(of.orderBy("snapshot_date")))
    none = F.lit(None)

    def thing(kind: int, item: Column, at: Column, name: Column, own: bool = False) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), item.alias("item"), at.alias("day"), name.alias("name"),
            (F.col("shows") if own else none.cast("array<string>")).alias("shows"), (F.col("reg") if own else none.cast("string")).alias("reg"),
        )

    def marks(e: Column) -> Column:
        name, fra, til = clean_name(e["navn"]), written_date(e["fraDato"]), written_date(e["tilDato"])
        text = F.lit(None).cast("string")
        every = F.array(
            F.when(til.isNotNull(), thing(0, name, til, name)), F.when(fra.isNotNull(), thing(2, name, fra, name)),
            F.when(fra.isNull() & til.isNull(), thing(-1, name, text, name)),
        )
        return F.filter(every, lambda t: t.isNotNull() & name.isNotNull())

    none_such = F.array().cast(THINGS)
    present = F.when(named, F.array(thing(1, F.lit(""), F.lit(None).cast("string"), F.col("name"), True))).otherwise(none_such)
    things = state.select("org", "_i", "shown", F.explode(F.array_distinct(F.concat(present, F.coalesce(F.flatten(F.transform("former", marks)), none_such)))).alias("t"))
    return differences(things.select("org", "_i", "shown", "t.*"), ["org", "kind", "item", "day"], ["name", "shown", "shows", "reg"], ["name"])


def name_history(register: DataFrame) -> DataFrame:
    """Each organisation's names with their periods, from the change events of its present and former names.

    The events are united on one time line for each organisation: a present name that appears (inserted or changed), one
    that was shown for the last time (changed or deleted), and the start and end of a former name when it is first
    listed. Lists that lack a former name later delete nothing. Where a former name's dates fall between the appearance
    and the end of a present name, that name goes on after them, from the next snapshot that shows it. Neighbours on
    the line with one name are one period, and ``lead`` gives each its end. Events that open a name before the last one is
    closed are no differences, and raise an error. A former name with neither date stands just
    before the first snapshot that lists it.
    """
    found = name_events(register)
    text = F.lit(None).cast("string")

    def event(day: Column, kind: Column | int, name: Column, shown: Column, opens: Column) -> Column:
        return F.struct(_at(day, kind).alias("at"), name.alias("name"), shown.alias("shown"), opens.alias("opens"))

    fresh, gone = F.col("change").isin("inserted", "changed"), F.col("change").isin("changed", "deleted")
    own = F.col("kind") == 1
    begins = F.when(own & fresh, event(F.col("shown"), 1, F.col("name"), F.col("shown"), F.col("name")))
    ends = F.when(own & gone, event(F.col("before_shown"), 1, F.col("before_name"), F.col("before_shown"), text))
    dated = F.coalesce("day", "shown")
    lists = F.when(~own & (F.col("change") == "inserted"), event(dated, F.col("kind"), F.col("name"), F.col("shown"), text))
    events = found.select("org", F.max("shows").over(W.partitionBy("org")).alias("shows"), F.max("reg").over(W.partitionBy("org")).alias("reg"), "kind", F.explode(F.filter(F.array(ends, begins, lists), lambda e: e.isNotNull())).alias("e"))
    events = events.groupBy("org", "e.name", "e.at", own.alias("own"), F.col("e.opens").alias("opens")).agg(F.min("e.shown").alias("shown"), F.first("shows").alias("shows"), F.first("reg").alias("reg"))
    line = W.partitionBy("org").orderBy("at", "shown", "name", F.col("opens").isNull())  # a start before the end of one snapshot
    state = F.struct(F.col("opens").alias("name"))
    last = F.last(F.when(F.col("own"), state), ignorenulls=True)
    events = events.withColumn("_open", last.over(line.rowsBetween(W.unboundedPreceding, 0))["name"]).withColumn("_was", last.over(line.rowsBetween(W.unboundedPreceding, -1))["name"]).withColumn("_next", F.lead("at").over(line))
    twice = F.col("opens").isNotNull() & F.col("_was").isNotNull()  # differences close a name before they open one
    events = events.withColumn("opens", F.when(twice, F.raise_error(F.lit("a name is opened while one is open: these are no differences of snapshots"))).otherwise(F.col("opens")))
    between = F.filter("shows", lambda s: (_at(s, 1) > F.col("at")) & (F.col("_next").isNull() | (_at(s, 1) < F.col("_next"))))
    goes_on = F.when(F.col("_open").isNotNull() & (F.size(between) > 0), F.struct(F.lit(1).alias("sub"), F.col("_open").alias("name"), F.array_min(between).alias("first"), F.array_max(between).alias("last"), F.array_min(between).alias("shown")))
    itself = F.struct(F.lit(0).alias("sub"), F.col("name"), F.col("at.day").alias("first"), F.col("at.day").alias("last"), F.col("shown"))
    shown = events.select("org", "reg", "at", F.col("shown").alias("_shown"), F.col("name").alias("_name"), F.col("opens").isNull().alias("_ends"), F.explode(F.filter(F.array(itself, goes_on), lambda e: e.isNotNull())).alias("e"))
    along = W.partitionBy("org").orderBy("at", "_shown", "_name", "_ends", "e.sub")
    shown = shown.withColumn("_new", (~F.lag("e.name").over(along).eqNullSafe(F.col("e.name"))).cast("int"))
    shown = shown.withColumn("_p", F.sum("_new").over(along.rowsBetween(W.unboundedPreceding, 0)))
    kind = F.when(F.col("e.sub") == 0, F.col("at.kind"))
    periods = shown.groupBy("org", "_p").agg(
        F.first("e.name").alias("navn"), F.first("reg").alias("reg"), F.min("e.first").alias("_first"), F.max("e.last").alias("_last"),
        F.min(F.when(kind == 2, F.col("at.day"))).alias("fra"), F.max(F.when(kind == 0, F.col("at.day"))).alias("til"), F.min("e.shown").alias("shown"),
    )
    periods = periods.withColumn("fra", F.when(F.col("fra") <= F.col("_first"), F.col("fra"))).withColumn("til", F.when(F.col("til") >= F.col("_last"), F.col("til")))
    order = W.partitionBy("org").orderBy("_p")
    start = F.when(F.col("_p") == 1, F.coalesce("fra", "reg", "shown")).otherwise(F.coalesce(F.lag("til").over(order), "fra", "shown"))
    valid = periods.withColumn("valid_from", start)
    valid = valid.withColumn("valid_to", F.coalesce(F.lead("valid_from").over(order), F.lit("")))
    return valid.select(F.col("org").alias("organisasjonsnummer"), "navn", "valid_from", "valid_to")
