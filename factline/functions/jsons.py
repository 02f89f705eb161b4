"""JSON: paths, flattening to dotted keys, verbatim pieces, linked-data walks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def flat(value: Any, skip: tuple[str, ...] = ("_links",)) -> dict[str, str]:
    """Dotted keys to text; lists of scalars joined with ', ', lists of objects numbered; null as ''."""
    out: dict[str, str] = {}

    def text(v: Any) -> str:
        return "" if v is None else ("true" if v else "false") if isinstance(v, bool) else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)

    def go(v: Any, path: str) -> None:
        if isinstance(v, dict):
            for k, x in v.items():
                if k not in skip:
                    go(x, f"{path}.{k}" if path else k)
        elif isinstance(v, list):
            if any(isinstance(x, (dict, list)) for x in v):
                for i, x in enumerate(v):
                    go(x, f"{path}.{i}")
            else:
                out[path] = ", ".join(text(x) for x in v if x is not None)
        else:
            out[path] = text(v)

    go(value, "")
    return out


@pandas_udf(T.MapType(T.StringType(), T.StringType()))
def json_flatten(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Dotted keys of each JSON text; null for null and for what isn't JSON."""

    def one(t: str | None) -> dict[str, str] | None:
        try:
            return None if t is None else flat(json.loads(t))
        except (ValueError, RecursionError):
            return None

    for batch in texts:
        yield batch.map(one)


_STEP = re.compile(r"\.([^.\[\]]+)|\[(\d+)\]|\[([\w.]+)=([^\]]*)\]")


def piece(text: str, path: str, limit: int | None = None) -> str | None:
    """The text of the value at a path ($.a.b[0].c, [key.path=value]) exactly as it is written, whole unless a limit is given.

    null where the path leads nowhere or can't be read.
    """
    if not path.startswith("$") or "/" in path or ".." in path:
        return None
    steps, at = [], 1
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            return None
        steps.append(m)
        at = m.end()
    decoder = json.JSONDecoder()
    space = re.compile(r"[\s,:]*")

    def members(start: int) -> Iterator[tuple[str | None, int, int]]:
        """(name or None, start, end) of the members of the object or array at start."""
        named, i = text[start] == "{", start + 1
        while True:
            i = space.match(text, i).end()
            if i >= len(text) or text[i] in "}]":
                return
            name = None
            if named:
                name, i = decoder.raw_decode(text, i)
                i = space.match(text, i).end()
            _, end = decoder.raw_decode(text, i)
            yield name, i, end
            i = end

    try:
        start = space.match(text).end()
        _, end = decoder.raw_decode(text, start)
        for m in steps:
            key, index, inner, want = m.groups()
            if text[start] not in "{[":
                return None
            found = None
            for n, (name, a, b) in enumerate(members(start)):
                if key is not None and name == key or index is not None and name is None and n == int(index):
                    found = a, b
                elif inner is not None and name is None:
                    v = json.loads(text[a:b])
                    for k in inner.split("."):
                        v = v.get(k) if isinstance(v, dict) else None
                    if v is not None and str(v) == want:
                        found = found or (a, b)
            if found is None:
                return None
            start, end = found
        return text[start:end][:limit]
    except (ValueError, RecursionError):
        return None


def linked_data(page: str) -> list[dict]:
    """Objects of the JSON-LD blocks of a page, nested ones and @graph included."""
    out: list[dict] = []

    def go(v: Any) -> None:
        if isinstance(v, list):
            for x in v:
                go(x)
        elif isinstance(v, dict):
            if "@type" in v:
                out.append(v)
            for x in v.values():
                go(x)

    for m in re.finditer(r"""<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>""", page, re.S | re.I):
        try:
            go(json.loads(m.group(1)))
        except (ValueError, RecursionError):
            continue
    return out
