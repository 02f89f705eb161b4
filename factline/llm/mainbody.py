"""The main body of pages, by the distribution of line blocks.

Markup is stripped into lines; a line of the page's visible text weighs as many characters as it has outside links and
buttons, times its share of main text, below. The edge of a container is an empty line. A block is the sum of the weights
over a sliding window of lines. A surge is a line whose block exceeds a threshold and that another line of weight follows
in the window; a dive is an edge, or a line that is no main text and whose block is below the threshold. The lines between a surge and its dive are the
main body, but for links.

Which lines are boilerplate is learned from the corpus; there are no lists of phrases. Lines are cut at separators into
pieces (the entries of a menu), and pieces are put in one form: small letters, with signs in place of numbers, of the
site's own name and of other names. Pages with markup whose headline stands in a container of its own tell for each form
under how many hosts it occurs in the headline's container and how many outside it; a form's share of main text is that quotient, without
the testimony of the page's own host (unless the host shows it under another headline too). A form that occurs nowhere
else has the share 1. A line's share is the mean over its pieces by length, smoothed over the lines next to it.

Counts are aggregated on the map side by form and host, then by form; forms and hosts that are hot are joined with salts.

Null or empty text: no lines. Null html: the weights come from the text and what other pages tell. Repeated pages testify
once. A page of any length is handled in time proportional to its lines.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hot_join
from ..runtime import materialize

#: Lines in a block; weight that a block must exceed for a surge.
WINDOW = 3
SURGE = 50.0
#: Testimonies for main text that every form starts with.
PRIOR = 0.5

_BULLET = re.compile(r"^\s*(?:[•*·–-]|\d+[.)])\s+")
_PARTS = re.compile(r"\s[»|/>›·]\s|\s{2,}")
_WORD = re.compile(r"[^\W\d_]+|\d+")
_TAG = re.compile(r"<(/?)([a-zA-Z][\w-]*)")
_CLOSING = {n: re.compile(f"</{n}\\s*>", re.I) for n in ("script", "style", "head")}
#: Elements that part text into blocks, those that hold others, and those whose text isn't the page's own.
_INLINE = frozenset("strong em b i span small sup sub u abbr code mark font img wbr".split())
_HOLDERS = frozenset("header nav main aside footer dialog section article td th tr table body ul ol form".split())
_SECTIONS = frozenset("header nav main aside footer dialog article".split())
_NAME = re.compile(r"""\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_LINKS = frozenset(("a", "button"))


def strip_markup(page: str) -> list[tuple[str, bool, str, str]]:
    """The text blocks of a page: text, whether it is a link or button, its container, its tag.

    Containers of one class or id, or of one sectioning element, are one: a body may go on after something set into it.
    """
    out: list[tuple[str, bool, str, str]] = []
    stack: list[tuple[str, int]] = [("body", 0)]
    containers, parts, tag, link = 1, [], "", 0
    holders: list[str] = [""]

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append((text, link > 0, holders[-1], tag))
        parts.clear()

    at, size = 0, len(page)
    while at < size:  # every sign is passed once, however badly elements are closed
        begin = page.find("<", at)
        if begin != at:
            parts.append(page[at:begin] if begin >= 0 else page[at:])
            if begin < 0:
                break
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = end + 3 if end >= 0 else size
            continue
        found, end = _TAG.match(page, begin), page.find(">", begin)
        if end < 0:
            break
        at = end + 1
        if not found:
            continue
        name, closes, whole = found.group(2), found.group(1), page[begin:at]
        if name.lower() in _CLOSING and not closes:
            rest = _CLOSING[name.lower()].search(page, at)
            if rest or name.lower() != "head":
                at = rest.end() if rest else size
                continue
        name = name.lower()
        if name in _INLINE:
            continue
        flush()
        if name in ("br", "hr", "meta", "link", "input"):
            continue
        if closes:
            while len(stack) > 1:
                top, held = stack.pop()
                link -= top in _LINKS
                if held:
                    holders.pop()
                if top == name:
                    break
            tag = stack[-1][0]
            continue
        hold = name in _HOLDERS or (name == "div" and _NAME.search(whole) is not None)
        if hold:
            kind = _NAME.search(whole)
            holders.append(f"{name} {kind.group(1) or kind.group(2)}" if kind else name if name in _SECTIONS else f"{name}#{containers}")
            containers += 1
        stack.append((name, int(hold)))
        link += name in _LINKS
        tag = name
    flush()
    return out


#: Lengths of the beginnings by which blocks are found.
_STARTS = (40, 12, 4, 1)


def align(lines: Sequence[str], blocks: list[tuple[str, bool, str, str]]) -> list[int | None]:
    """For each text line the number of the block that it is, or is a part of, in the blocks' order; None if none is."""
    places: dict[str, list[int]] = {}
    for j, (whole, *_) in enumerate(blocks):
        for n in _STARTS:
            if len(whole) >= n:
                places.setdefault(f"{n}{whole[:n]}", []).append(j)

    def find(form: str, at: int) -> int | None:
        size = next((n for n in _STARTS if len(form) >= n), None)
        found = places.get(f"{size}{form[:size]}", ()) if size else ()
        return next((j for j in found[bisect_left(found, at) :] if blocks[j][0].startswith(form)), None) if found else None

    out: list[int | None] = []
    at, used = 0, 0
    for line in lines:
        text = " ".join(line.split())
        hit = None
        for form in (text, _BULLET.sub("", text)):
            if used and at < len(blocks) and blocks[at][0].startswith(form, used):
                hit, end = at, used + len(form) + 1
                break
            hit = find(form, at + (used > 0))
            if hit is not None:
                end = len(form) + 1
                break
        out.append(hit)
        if hit is None:
            continue
        at, used = (hit + 1, 0) if end >= len(blocks[hit][0]) else (hit, end)
    return out


def headline_of(title: str | None) -> str:
    """The title without the site's name after its last dash or bar."""
    if not title:
        return ""
    last = max(title.rfind(f" {mark} ") for mark in "–|-")
    return " ".join(title[:last].split()) if last > 0 else ""


_PLAIN = str.maketrans("æøåäöü", "eoaaou")


def _own_words(host: str | None, title: str | None) -> str:
    """The signs of the site's name, in which its words are looked for."""
    last = max((title or "").rfind(f" {mark} ") for mark in "–|-")
    return re.sub(r"[^a-z0-9]", "", (host or "").lower().replace("ae", "e").replace("oe", "o").replace("aa", "a") + ((title or "")[last:].lower().translate(_PLAIN) if last > 0 else ""))


def form_of(piece: str, own: str) -> str:
    """The form of a piece: small letters, numbers as #, words of the site's name as @, other names as ^."""

    def one(m: re.Match[str]) -> str:
        w = m.group()
        if w[0].isdigit():
            return "#"
        low = w.lower()
        if w[0] != low[0]:
            if len(w) > 2 and low.translate(_PLAIN).replace("ae", "e") in own:
                return "@"
            if m.start() > 0 and not w.isupper():
                return "^"
        return low

    return re.sub(r"(?:\^[ -]?)+(?<! )", "^", re.sub(r"(?:@[ -]?)+(?<! )", "@", re.sub(r"(?:#[ ]?)+(?<! )", "#", _WORD.sub(one, " ".join(piece.split())).strip(" \t:….*›!"))))


def _hash(form: str) -> int:
    return xxhash.xxh64_intdigest(form) - (1 << 63)


def page_lines(host: str | None, title: str | None, text: str, page: str | None) -> tuple[list[tuple[int, int, bool, bool]], list[tuple[int, int, int, int]]]:
    """The lines of a page that aren't blank, as number, characters, whether an edge is before it, whether it is a link;
    and their pieces as line (its place among them), form, characters, and testimony: 1 main text, -1 none, 0 unknown."""
    raw = text.split("\n")
    numbers = [i for i, line in enumerate(raw) if line.strip()]
    lines = [raw[i].strip() for i in numbers]
    blocks = strip_markup(page) if page else []
    marks = align(lines, blocks) if blocks else [None] * len(lines)
    headline = headline_of(title)
    start = next((i for i, m in enumerate(marks) if m is not None and blocks[m][3] == "h1"), None)
    if start is None and headline:
        start = next((i for i, line in enumerate(lines) if " ".join(line.split()) == headline), None)
    home = blocks[marks[start]][2] if start is not None and marks[start] is not None else None
    told = home is not None and any(m is not None and blocks[m][2] != home for m in marks)
    own = _own_words(host, title)
    rows: list[tuple[int, int, bool, bool]] = []
    pieces: list[tuple[int, int, int, int]] = []
    before: int | None = None
    for i, (line, m) in enumerate(zip(lines, marks, strict=True)):
        edge = m is not None and before is not None and blocks[m][2] != blocks[before][2]
        before = m if m is not None else before
        link = m is not None and blocks[m][1]
        rows.append((numbers[i], len(line), edge, link))
        if i == start or " ".join(line.split()) == headline:
            continue  # the page's own headline is no boilerplate wherever else it is shown
        says = 0 if not told or m is None else -1 if link or blocks[m][2] != home else 1
        wrapped = m is not None and len(blocks[m][0]) > len(line) + 4  # a line that is cut off is known by its whole block
        for part in [blocks[m][0]] if wrapped else _PARTS.split(line):
            form = form_of(part, own)
            if form:
                pieces.append((i, _hash(form), len(line) if wrapped else len(part.strip()), says))
    return rows, pieces


_PAGES = "page_id long, host string, headline string, numbers array<int>, sizes array<int>, edges array<boolean>, links array<boolean>, pieces array<struct<line:int,form:long,size:int,says:int>>"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for page_id, host, page, text, title in batch.itertuples(index=False, name=None):
            rows, pieces = page_lines(host, title, text, page)
            numbers, sizes, edges, links = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [])
            out.append((page_id, host, headline_of(title), numbers, sizes, edges, links, [dict(zip(("line", "form", "size", "says"), p, strict=True)) for p in pieces]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _PAGES.split(", ")])


def body_of(sizes: np.ndarray, shares: np.ndarray, edges: np.ndarray, links: np.ndarray, window: int = WINDOW, surge: float = SURGE) -> np.ndarray:
    """Whether each line lies between a surge and its dive."""
    n = len(sizes)
    share = np.where(links, 0.0, shares)
    run = np.cumsum(edges)
    reach = window - 1
    smooth = np.zeros(n)
    count = np.zeros(n)
    for d in range(-reach, reach + 1):  # over the neighbours in the same container
        a, b = max(0, d), min(n, n + d)
        if a >= b:
            continue
        same = run[a:b] == run[a - d : b - d]
        smooth[a - d : b - d] += np.where(same, share[a:b], 0.0)
        count[a - d : b - d] += same
    weight = sizes * share * smooth / np.maximum(count, 1)
    block, later = np.zeros(n), np.zeros(n, bool)
    for d in range(window):
        if d >= n:
            break
        same = run[d:] == run[: n - d]
        block[: n - d] += np.where(same, weight[d:], 0.0)
        if d:
            later[: n - d] |= same & (weight[d:] > 0)
    inside = np.zeros(n, bool)
    on = False
    for i in range(n):
        if edges[i]:
            on = False
        if on and share[i] < 0.5 and block[i] <= surge:
            on = False
        if not on and share[i] >= 0.5 and block[i] > surge and later[i]:
            on = True
        inside[i] = on
    return inside & ~links


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids, numbers = [], []
        for page_id, nos, sizes, edges, links, known in batch[["page_id", "numbers", "sizes", "edges", "links", "known"]].itertuples(index=False, name=None):
            n = len(nos)
            if not n:
                continue
            size = np.asarray(sizes, float)
            lost = np.zeros(n)
            if known is not None:
                for k in known:
                    lost[k["line"]] += k["lost"]
            shares = 1 - np.minimum(1.0, lost / np.maximum(size, 1.0))
            inside = body_of(size, shares, np.asarray(edges, bool), np.asarray(links, bool))
            kept = np.asarray(nos)[inside]
            ids.append(np.full(len(kept), page_id, np.int64))
            numbers.append(kept.astype(np.int32))
        if ids:
            yield pd.DataFrame({"page_id": np.concatenate(ids), "line_no": np.concatenate(numbers)})


def testimony(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What pages with markup tell of forms, by form and host (i, o: whether it is inside and outside the headline's
    container there, or without containers under several headlines; ii, oo: under several headlines) and by form (ti, to:
    under how many hosts)."""
    said = pages.where("host is not null").select("host", "headline", F.explode("pieces").alias("p"))

    def several(says: int) -> list[Column]:
        there = F.when(F.col("p.says") == says, F.col("headline"))
        return [F.min(there).alias(f"a{says + 1}"), F.max(there).alias(f"b{says + 1}")]

    by_host = said.groupBy(F.col("p.form").alias("form"), "host").agg(*several(1), *several(-1), *several(0))
    repeated = F.coalesce(F.col("a1") < F.col("b1"), F.lit(False))  # where no container tells, under several headlines
    out = F.col("a0").isNotNull() | repeated
    by_host = by_host.select("form", "host", F.col("a2").isNotNull().cast("int").alias("i"), out.cast("int").alias("o"), (F.col("a2") < F.col("b2")).alias("ii"), (F.coalesce(F.col("a0") < F.col("b0"), F.lit(False)) | repeated).alias("oo"))
    by_host = materialize(by_host.where("i + o > 0"), "forms-by-host")
    total = by_host.groupBy("form").agg(F.sum("i").alias("ti"), F.sum("o").alias("to")).where("to > 0")
    return by_host, materialize(total, "forms")


def main_body(pages: DataFrame) -> DataFrame:
    """page_id and line_no of the lines of text that are main content."""
    rows = pages.where("text is not null and text <> '' and page_id is not null").select("page_id", "host", "html", "text", "title")
    rows = materialize(rows.mapInPandas(_read, _PAGES), "page-lines")
    by_host, total = testimony(rows)
    pieces = rows.select("page_id", "host", F.posexplode("pieces").alias("k", "p")).select("page_id", "host", "k", "p.line", "p.form", "p.size")
    pieces = hot_join(pieces, total, "form")
    at = F.xxhash64("form", F.coalesce("host", F.lit("")))
    own = by_host.select(at.alias("at"), "i", "o", "ii", "oo")
    pieces = pieces.withColumn("at", at)
    scored = hot_join(materialize(pieces, "known-pieces"), own, "at", how="left")
    i = F.col("ti") - F.when(F.col("ii"), 0).otherwise(F.coalesce("i", F.lit(0)))
    o = F.col("to") - F.when(F.col("oo"), 0).otherwise(F.coalesce("o", F.lit(0)))
    lost = F.col("size") * o / (o + i + F.lit(PRIOR))
    known = scored.select("page_id", "k", "line", lost.alias("lost")).where("lost > 0")
    known = known.groupBy("page_id").agg(F.collect_set(F.struct("k", "line", "lost")).alias("known"))  # a page that is there twice counts once
    return rows.drop("pieces").join(known, "page_id", "left").mapInPandas(_windows, "page_id long, line_no int").distinct()
