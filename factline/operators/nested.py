"""Deeply nested records as related flat tables, by Merkle subtree identities.

Objects are canonicalised and hashed bottom-up: an object's identity is the first 128 bits of the SHA-256 of its scalar members
(in order of their names) and of its children's identities, so equal subtrees have one identity wherever they occur. ``objects``
stores each identity once; ``bridge`` keeps every occurrence of a child in its parent by member name and ordinal, null
elements included; ``roots`` links each record's key to its root.

objects: hash, kind (object, array, scalar, null), content (JSON of the scalar members, of the value, or of the length).
bridge: parent, member, ordinal (-1: the member itself, no array), child. An array in an object is spread over its
member's ordinals, with an ordinal of -2 and no child for an empty array; arrays right in arrays, and an array as root,
are objects of kind array with the member ''.
roots: the record's key, root. A null record has no row; text that isn't JSON becomes a scalar.

Depth has no bound: texts that are too deep for the JSON library are parsed with an explicit stack, and the walk has one
too. Text that isn't JSON becomes a scalar. Doubles are compared by their shortest text, member order and spacing don't
matter, of repeated members the last holds. Lone surrogates count in identities and are given out as escapes. Repeats
are reduced where they are read; an identity's content and children are one row, so one aggregation stores it once.
Identities that very many parents share are found once, and joined in parts (``hot_join``).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from json.decoder import scanstring
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .skew import hot_join, hot_keys

EMPTY = -2
SINGLE = -1


def _dumps(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


Children = list[tuple[str, int, str | None]]


def _sha(kind: str, content: str, children: Children) -> str:
    """128 bits of the SHA-256 of all parts, each after its length, so no two lists of parts are one text."""
    parts = [kind, content]
    for m, o, c in children:
        parts += (m, str(o), c or "")
    return hashlib.sha256("".join([f"{len(p)}:{p}" for p in parts]).encode("utf-8", "surrogatepass")).hexdigest()[:32]


def walk(value: Any, objects: dict[str, tuple[str, str, Children]]) -> str:
    """The identity of a parsed JSON value; objects gets every identity below it with its kind, content and children."""
    order: list[Any] = [value]
    plans: list[tuple[str, str, list[tuple[str, int, int | None]]]] = []
    for v in order:  # grows while it is walked
        children: list[tuple[str, int, int | None]] = []
        if isinstance(v, dict):
            kind, scalars = "object", {}
            for k in sorted(v):
                x = v[k]
                if isinstance(x, dict):
                    children.append((k, SINGLE, len(order)))
                    order.append(x)
                elif isinstance(x, list):
                    children += [(k, i, len(order) + i) for i in range(len(x))] or [(k, EMPTY, None)]
                    order += x
                else:
                    scalars[k] = x
            content = _dumps(scalars)
        elif isinstance(v, list):
            kind, content = "array", str(len(v))
            children = [("", i, len(order) + i) for i in range(len(v))]
            order += v
        else:
            kind, content = ("null" if v is None else "scalar"), _dumps(v)
        plans.append((kind, content, children))
    keys = [""] * len(plans)
    for i in range(len(plans) - 1, -1, -1):  # children come after their parents
        kind, content, places = plans[i]
        children = [(m, o, None if c is None else keys[c]) for m, o, c in places]
        keys[i] = _sha(kind, content, children)
        objects.setdefault(keys[i], (kind, content, children))
    return keys[0]


_SPACE = re.compile(r"[ \t\n\r]*")
_ATOM = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity")


def parse_deep(text: str) -> Any:
    """The value of a JSON text of any depth, with an explicit stack; ValueError if it isn't JSON."""
    out: list[Any] = []
    stack: list[Any] = [out]
    names: list[str | None] = [None]
    at, size = _SPACE.match(text).end(), len(text)
    ready, first = True, False  # whether a value may come, and whether the container may end before it

    def put(v: Any) -> None:
        if isinstance(stack[-1], dict):
            stack[-1][names[-1]] = v
        else:
            stack[-1].append(v)

    while at < size:
        c = text[at]
        if c in "}]" and len(stack) > 1 and (first or not ready) and isinstance(stack[-1], dict if c == "}" else list):
            stack.pop()
            names.pop()
            at, ready, first = at + 1, False, False
        elif not ready and c == "," and len(stack) > 1:
            at, ready = at + 1, True
        elif ready:
            if isinstance(stack[-1], dict):
                if c != '"':
                    raise ValueError("a member has no name")
                names[-1], at = scanstring(text, at + 1)
                at = _SPACE.match(text, at).end()
                if text[at : at + 1] != ":":
                    raise ValueError("a member has no value")
                at = _SPACE.match(text, at + 1).end()
                c = text[at : at + 1]
            if c == '"':
                v, at = scanstring(text, at + 1)
                put(v)
                ready, first = False, False
            elif c and c in "{[":
                v = {} if c == "{" else []
                put(v)
                stack.append(v)
                names.append(None)
                at, first = at + 1, True
            else:
                found = _ATOM.match(text, at)
                if not found:
                    raise ValueError("no value")
                put(json.loads(found.group()))
                at, ready, first = found.end(), False, False
        else:
            raise ValueError("something follows a value")
        at = _SPACE.match(text, at).end()
    if len(stack) > 1 or len(out) != 1 or ready:
        raise ValueError("the text ends too early")
    return out[0]


def parse(text: str) -> Any:
    """The value of a JSON text; the text itself if it isn't JSON."""
    try:
        return json.loads(text)
    except RecursionError:
        try:
            return parse_deep(text)
        except ValueError:
            return text
    except ValueError:
        return text


def walk_text(text: str, objects: dict[str, tuple[str, str, Children]]) -> str:
    """The identity of a JSON text."""
    return walk(parse(text), objects)


_LONE = re.compile("[\ud800-\udfff]")


def _shown(text: str | None) -> str | None:
    """text with lone surrogates as JSON escapes, as UTF-8 has no place for them."""
    return text if text is None or text.isascii() else _LONE.sub(lambda m: f"\\u{ord(m.group()):04x}", text)


def rebuild(root: str, objects: dict[str, tuple[str, str]], bridge: dict[str, list[tuple[str, int, str | None]]]) -> Any:
    """The value of an identity (of ordinary depth), from rows of objects (hash to kind and content) and bridge (parent to its children)."""
    kind, content = objects[root]
    children = sorted(bridge.get(root, []), key=lambda x: (x[0], x[1]))
    if kind == "array":
        return [rebuild(c, objects, bridge) for _, _, c in children]
    out = json.loads(content)
    for member, ordinal, child in children:
        if ordinal == SINGLE:
            out[member] = rebuild(child, objects, bridge)
        elif ordinal == EMPTY:
            out[member] = []
        else:
            out.setdefault(member, []).append(rebuild(child, objects, bridge))
    return out


#: Distinct identities that a task remembers as already given; a full memory is dropped, which costs only repeats.
REMEMBERED = 200_000

_CHILD = pa.struct([("member", pa.string()), ("ordinal", pa.int32()), ("child", pa.string())])
_ARROW = pa.schema([("part", pa.string()), ("key", pa.string()), ("root", pa.string()), ("kind", pa.string()), ("content", pa.string()), ("children", pa.list_(_CHILD))])
_ROWS = "part string, key string, root string, kind string, content string, children array<struct<member:string,ordinal:int,child:string>>"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    offsets, members, ordinals, children = [0], [], [], []
    for row in columns[5]:
        for m, o, c in row:
            members.append(_shown(m))
            ordinals.append(o)
            children.append(c)
        offsets.append(len(members))
    inner = pa.StructArray.from_arrays([pa.array(members, pa.string()), pa.array(ordinals, pa.int32()), pa.array(children, pa.string())], fields=list(_CHILD))
    nested = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:5]), nested.cast(_ARROW.field(5).type)], schema=_ARROW)


def _shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    given: set[str] = set()
    for batch in batches:
        out: list[tuple] = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            objects: dict[str, tuple[str, str, Children]] = {}
            out.append(("root", key, walk_text(text, objects), None, None, ()))
            for h, (kind, content, children) in objects.items():
                if h not in given:
                    given.add(h)
                    out.append(("object", h, None, kind, _shown(content), children))
            if len(given) > REMEMBERED:
                given.clear()
            if len(out) > 20_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)


class Shredded:
    """The three tables of shred()."""

    def __init__(self, roots: DataFrame, objects: DataFrame, bridge: DataFrame, hot: Sequence[str] = ()):
        self.roots, self.objects, self.bridge, self.hot = roots, objects, bridge, hot

    def under(self, parents: DataFrame, at: str, member: str, child: str, ordinal: str | None = None) -> DataFrame:
        """parents with each child by that member, in the columns child and ordinal; parents without it drop out.

        at is the column with the parent's identity. With ordinal, single objects have the place 0 and null elements
        keep theirs.
        """
        rows = self.bridge.where((F.col("member") == member) & F.col("child").isNotNull())
        rows = rows.select(F.col("parent").alias(at), F.greatest(F.col("ordinal"), F.lit(0)).alias(ordinal or "_o"), F.col("child").alias(child))
        return hot_join(parents, rows, at, self.hot).drop("_o")

    def content(self, parents: DataFrame, at: str, name: str, condition: Column) -> DataFrame:
        """parents with the content of the object in the column at; condition is on kind and content."""
        rows = self.objects.where(condition).select(F.col("hash").alias(at), F.col("content").alias(name))
        return hot_join(parents, rows, at, self.hot)


def shred(records: DataFrame, key: str, body: str, name: str = "shredded") -> Shredded:
    """The tables of the records' bodies; body is JSON text, or a struct or array, whose null members are kept."""
    kind = records.schema[body].dataType.typeName()
    text = F.col(body) if kind == "string" else F.to_json(F.col(body), {"ignoreNullFields": "false"})
    rows = materialize(records.select(F.col(key).cast("string").alias("key"), text.alias("text")).where("text is not null").mapInArrow(_shred, _ROWS), name, ["part"])
    roots = rows.where("part = 'root'").select("key", "root")
    stored = rows.where("part = 'object'").select(F.col("key").alias("hash"), "kind", "content", "children").dropDuplicates(["hash"])
    stored = materialize(stored, f"{name}-objects")
    bridge = stored.select(F.col("hash").alias("parent"), F.explode("children").alias("c")).select("parent", "c.member", "c.ordinal", "c.child")
    uses = bridge.select("child").unionByName(roots.select(F.col("root").alias("child")))
    return Shredded(roots, stored.drop("children"), bridge, hot_keys(uses, "child"))  # identities that occur very often


def latest_body(rows: DataFrame, key: str, at: str, body: str) -> DataFrame:
    """key and body of each key's latest row that has a body (as JSON text); of equally late ones the greatest text."""
    kind = rows.schema[body].dataType.typeName()
    text = F.col(body) if kind == "string" else F.to_json(F.col(body), {"ignoreNullFields": "false"})
    good = rows.select(F.col(key).alias("key"), F.col(at).alias("at"), text.alias("body")).where("key is not null and body is not null")
    return good.groupBy("key").agg(F.max(F.struct("at", "body")).alias("m")).select("key", F.col("m.body").alias("body"))
