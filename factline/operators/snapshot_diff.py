"""What changed between consecutive full snapshots, by invertible Bloom lookup tables.

Each snapshot's rows become a 128-bit key hash and a 64-bit hash of the values, which are shuffled once, by hash bucket;
copies of a row are put together before, batch by batch, so a hot key is no hot bucket. In its task each bucket of each
snapshot becomes a table of cells. The table of a snapshot less that of the snapshot before leaves what differs, as
equal pairs cancel out; peeling its cells gives back exactly the differing pairs, and a digest of the whole bucket, kept
beside the cells, proves it. Where that fails both tables are built again with as many cells as the filling asks for. A
key recovered on both sides was changed, on one side added or removed. What is shuffled is about 40 bytes for each row,
however many tasks there are; what leaves the buckets follows the differences.

Nulls: null and '' in a key column are one where the caller maps them so; any null is a value of its own. Of rows of
one key and snapshot the one with the latest version column holds, then the greatest value hash. Snapshots without rows
don't exist: consecutive are those that do. An empty table or a single snapshot gives no changes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import bounded_broadcast, materialize

#: Hash functions of a table; each has a range of cells of its own.
HASHES = 4
#: Rows of one snapshot that a bucket should hold, and cells for each of them in the first round.
BUCKET_ROWS = 4096
FIRST_CELLS = 2048
#: Rounds of enlarging; a round at least doubles the cells, so only a defect could use them up, and raises RuntimeError.
ROUNDS = 24
#: Differences that are broadcast to the rows to be named; with more of them both sides are shuffled.
FOUND_ROWS = 200_000


def canonical_json(value: Column, without: Sequence[str] = ()) -> Column:
    """JSON text with sorted members and no spacing, without the named members of a top object; other text as it is."""
    plain = F.to_json(F.try_parse_json(value))
    out = F.coalesce(plain, value)
    if without:
        members = F.from_json(value, T.MapType(T.StringType(), T.VariantType()), {"mode": "PERMISSIVE"})
        kept = F.filter(F.map_entries(members), lambda e: ~e["key"].isin(*without))
        pairs = F.transform(kept, lambda e: F.struct(e["key"].alias("k"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("v")))
        text = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(F.lit('"'), p["k"], F.lit('":'), p["v"])), ","), F.lit("}"))
        holds = F.lit(False)
        for m in without:
            holds = holds | value.contains(f'"{m}"')
        out = F.when(holds & F.ltrim(value).startswith("{") & plain.isNotNull(), F.coalesce(text, out)).otherwise(out)
    return out


def hash_of(seed: str, *cols: Column) -> Column:
    """A 64-bit hash in which null and every place of a column count."""
    parts: list[Column] = [F.lit(seed)]
    for c in cols:
        parts += [c.isNull().cast("int"), c]
    return F.xxhash64(*parts)


def hashed_rows(rows: DataFrame, snapshot: str, keys: dict[str, Column], values: Sequence[Column], version: str) -> DataFrame:
    """snapshot, hashes h1 and h2 of the key and v of the values, and at, the version as a number (null: the least)."""
    kind = rows.schema[version].dataType
    at = F.col(version)
    if isinstance(kind, T.TimestampType):
        at = F.unix_micros(at)
    elif isinstance(kind, T.TimestampNTZType):
        at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), at)
    elif isinstance(kind, T.DateType):
        at = F.unix_date(at)
    elif not isinstance(kind, T.IntegralType):
        raise TypeError(f"{version} is neither a number nor an instant")
    cols = list(keys.values())
    return rows.where(F.col(snapshot).isNotNull()).select(F.col(snapshot).cast("int").alias("snapshot"), hash_of("a", *cols).alias("h1"), hash_of("b", *cols).alias("h2"), hash_of("v", *values).alias("v"), F.coalesce(at.cast("long"), F.lit(-(1 << 63))).alias("at"))


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_CHECK = 7_000


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xx_longs(first: int, *cols: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a long literal and long columns (seed 42), so cells can be found again while peeling."""
    with np.errstate(over="ignore"):
        h = np.full(len(cols[0]), 42, np.uint64)
        for c in (np.full(len(cols[0]), first, np.int64), *cols):
            x = h + _P5 + np.uint64(8)
            x = x ^ (_turn(c.view(np.uint64) * _P2, 31) * _P1)
            x = _turn(x, 27) * _P1 + _P4
            x = (x ^ (x >> np.uint64(33))) * _P2
            x = (x ^ (x >> np.uint64(29))) * _P3
            h = x ^ (x >> np.uint64(32))
    return h.view(np.int64)


Table = tuple[np.ndarray, ...]


def build(cells: int, h1: np.ndarray, h2: np.ndarray, v: np.ndarray) -> Table:
    """The table of some pairs: count, and the exclusive ors of h1, h2, v and the check hash, by cell; last the digest.

    Hash function i has the i-th part of the cells, a multiple of HASHES, to itself.
    """
    width = cells // HASHES
    fields = (h1, h2, v, xx_longs(_CHECK, h1, h2, v))
    count, xors = np.zeros(cells + 1, np.int64), [np.zeros(cells + 1, np.int64) for _ in fields]
    count[cells] = len(h1)
    for x, f in zip(xors, fields, strict=True):
        x[cells] = np.bitwise_xor.reduce(f) if len(f) else 0
    for i in range(HASHES):
        at = i * width + np.mod(xx_longs(i, h1, h2, v), width)
        count[:cells] += np.bincount(at, minlength=cells)
        for x, f in zip(xors, fields, strict=True):
            np.bitwise_xor.at(x, at, f)
    return (count, *xors)


def subtract(later: Table, earlier: Table) -> Table:
    """What differs: equal pairs of both tables are gone."""
    return (later[0] - earlier[0], *(a ^ b for a, b in zip(later[1:], earlier[1:], strict=True)))


def peel(cells: int, at: np.ndarray, n: np.ndarray, *xors: np.ndarray) -> tuple[bool, int, list[np.ndarray]]:
    """Peel one subtracted table, given by its cells that aren't empty; cell -1 is the digest.

    Returns whether all of it was recovered and the digest agrees, the number of entries that its filling suggests,
    and the entries' sides, h1, h2 and v.
    """
    width = cells // HASHES
    count = np.zeros(cells, np.int64)
    fields = [np.zeros(cells, np.int64) for _ in xors]
    digest, inner = at < 0, at >= 0
    count[at[inner]] = n[inner]
    for f, x in zip(fields, xors, strict=True):
        f[at[inner]] = x[inner]
    empty = int(((count == 0) & (fields[3] == 0) & (fields[0] == 0)).sum())
    guess = int(-width * np.log(empty / cells)) if empty else 16 * cells
    found: list[list[np.ndarray]] = [[], [], [], []]
    live = np.flatnonzero(np.abs(count) == 1)
    while live.size:
        side, a, b, c, check = count[live], *(f[live] for f in fields)
        places = np.stack([i * width + np.mod(xx_longs(i, a, b, c), width) for i in range(HASHES)], axis=1)
        pure = (xx_longs(_CHECK, a, b, c) == check) & (places == live[:, None]).any(axis=1)
        if not pure.any():
            break
        side, a, b, c, check, places = side[pure], a[pure], b[pure], c[pure], check[pure], places[pure]
        _, first = np.unique(np.stack([a, b, c]), axis=1, return_index=True)  # alone in several of its cells
        side, a, b, c, check, places = side[first], a[first], b[first], c[first], check[first], places[first]
        for store, x in zip(found, (side, a, b, c), strict=True):
            store.append(x)
        for i in range(HASHES):
            np.subtract.at(count, places[:, i], side)
            for f, x in zip(fields, (a, b, c, check), strict=True):
                np.bitwise_xor.at(f, places[:, i], x)
        live = np.unique(places)
        live = live[np.abs(count[live]) == 1]
    out = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in found]
    clean = not count.any() and not any(f.any() for f in fields)
    want = [int(n[digest].sum()), *(int(np.bitwise_xor.reduce(x[digest])) if digest.any() else 0 for x in xors)]
    have = [int(out[0].sum()), *(int(np.bitwise_xor.reduce(x)) if x.size else 0 for x in (*out[1:], xx_longs(_CHECK, *out[1:]) if out[0].size else out[1]))]
    return clean and want == have, guess, out


_ENTRY = ("snapshot", "h1", "h2", "v", "at")
_ENTRIES = "bucket long, snapshot int, h1 long, h2 long, v long, at long"
_FOUND = "pair int, before int, h1 long, h2 long, added boolean, removed boolean"


def _latest(snapshot: np.ndarray, h1: np.ndarray, h2: np.ndarray, v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places of one row for each key and snapshot: that of the greatest at, then of the greatest v."""
    order = np.lexsort((v, at, h2, h1, snapshot))
    a, b, c = snapshot[order], h1[order], h2[order]
    last = np.ones(len(order), bool)
    last[:-1] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
    return order[last]


def _put_together(buckets: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cols = [b[c].to_numpy(np.int64) for c in _ENTRY]
            kept = _latest(*cols)
            out = {c: x[kept] for c, x in zip(_ENTRY, cols, strict=True)}
            yield pd.DataFrame({"bucket": np.mod(out["h1"], buckets), **out}).astype({"snapshot": "int32"})

    return run


def _compare(order: Sequence[int], first_cells: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """What differs in a bucket between every two consecutive snapshots."""

    def run(_: tuple, bucket: pd.DataFrame) -> pd.DataFrame:
        cols = [bucket[c].to_numpy(np.int64) for c in _ENTRY]
        kept = _latest(*cols)
        snapshot, h1, h2, v = (x[kept] for x in cols[:4])
        tables: dict[tuple[int, int], Table] = {}

        def table(s: int, cells: int) -> Table:
            if (s, cells) not in tables:
                rows = slice(*np.searchsorted(snapshot, (s, s + 1)))  # kept is in the order of snapshots
                tables[s, cells] = build(cells, h1[rows], h2[rows], v[rows])
            return tables[s, cells]

        parts = []
        for before, pair in zip(order, order[1:], strict=False):
            cells = first_cells
            for _ in range(ROUNDS):
                count, *xors = subtract(table(pair, cells), table(before, cells))
                at = np.append(np.arange(cells), -1)
                ok, guess, (side, a, b, _v) = peel(cells, at, count, *xors)
                if ok:
                    break
                cells = max(2 * cells, int(1.6 * guess) + 64) // HASHES * HASHES
            else:
                raise RuntimeError("a bucket couldn't be recovered")
            parts.append(pd.DataFrame({"pair": pair, "before": before, "h1": a, "h2": b, "added": side > 0, "removed": side < 0}))
            for key in [k for k in tables if k[0] != pair]:
                del tables[key]
        out = pd.concat(parts) if parts else pd.DataFrame({c.split()[0]: [] for c in _FOUND.split(", ")})
        return out.groupby(["pair", "before", "h1", "h2"], as_index=False)[["added", "removed"]].any().astype({"pair": "int32", "before": "int32", "h1": "int64", "h2": "int64", "added": bool, "removed": bool})

    return run


def differing(rows: DataFrame, bucket_rows: int = BUCKET_ROWS, first_cells: int = FIRST_CELLS) -> DataFrame:
    """pair (the later snapshot), before (the earlier), h1, h2, added, removed of every key that differs.

    rows: snapshot, h1, h2, v, at; of several rows of a key and snapshot that of the greatest at, then v, holds.
    """
    sizes = {r["snapshot"]: r["count"] for r in rows.groupBy("snapshot").count().collect()}  # one row for each snapshot
    buckets = max(1, -(-max(sizes.values(), default=0) // bucket_rows))
    entries = rows.select(*_ENTRY).mapInPandas(_put_together(buckets), _ENTRIES)
    return entries.groupBy("bucket").applyInPandas(_compare(sorted(sizes), first_cells), _FOUND)


def changes(rows: DataFrame, snapshot: str, keys: dict[str, Column], values: Sequence[Column], version: str, **sizes: int) -> DataFrame:
    """snapshot (the later), the key columns and change (added, removed, changed) for each pair of consecutive snapshots."""
    found = materialize(differing(hashed_rows(rows, snapshot, keys, values, version), **sizes), "differences")
    kind = F.when(F.col("added") & F.col("removed"), "changed").when(F.col("added"), "added").otherwise("removed")
    found = found.select("pair", "h1", "h2", kind.alias("_change"), F.when(F.col("added"), F.col("pair")).otherwise(F.col("before")).alias("snapshot"))
    cols = list(keys.values())
    names = rows.where(F.col(snapshot).isNotNull()).select(F.col(snapshot).cast("int").alias("snapshot"), hash_of("a", *cols).alias("h1"), hash_of("b", *cols).alias("h2"), *[c.alias(k) for k, c in keys.items()])
    named = names.join(bounded_broadcast(found, FOUND_ROWS), ["snapshot", "h1", "h2"])
    return named.select(F.col("pair").alias("snapshot"), *keys, F.col("_change").alias("change")).distinct()
