"""One consistent form for text that looks the same, by a compiled longest-match transducer over grapheme clusters.

The mapping is computed once, from rules, into a trie: full-width forms and the ideographic space to their ordinary
signs, no-break and fixed-width spaces of a space's look to spaces, invisible signs to nothing, a fixed table of
look-alike letters, and every canonical decomposition (accented letters, syllables) as a path from its base letter over
its marks to its composed sign. Letters that look alike are one node, so each path is entered once for all of them. The
table is checked when it is compiled: no path may have two targets, and every target must be its own target. Signs that
differ in shape, size or position (superscripts, circled digits, fractions, half-width kana, the trade mark and numero
signs) stay as they are.

A text is rewritten in one pass over its clusters: from the base's node each mark, in canonical order, leads on as long
as the trie goes; marks that it doesn't know follow the longest match unchanged, unless they lie between two of the
path. Runs of signs that the table doesn't touch are copied at once.

Invisible are the soft hyphen, zero-width spaces, joiners and marks, word joiners, invisible operators, directional
marks, isolates and embeddings (overrides turn the text and stay), the grapheme joiner and variation selectors. Zero-width
joiners and selectors stay between or after pictographs, joiners also in Arabic script, where they show. CR LF and CR
become LF. Null stays null, '' stays ''. Any length is handled in one pass over the text.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..operators.skew import hot_join
from ..runtime import materialize

# Letters of other scripts and letter-like signs, each with the Latin letter of the same shape.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ѵ": "V", "Ӏ": "I", "Ԍ": "G",
    "ο": "o", "α": "a", "ν": "v", "ϲ": "c", "ϳ": "j", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "օ": "o", "հ": "h", "ո": "n", "ս": "u", "Օ": "O", "Տ": "S", "Ս": "U",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲏ": "H", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲭ": "X",
    "ɡ": "g", "ⅰ": "i", "ⅴ": "v", "ⅹ": "x", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m", "Ⅰ": "I", "Ⅴ": "V", "Ⅹ": "X", "Ⅼ": "L", "Ⅽ": "C", "Ⅾ": "D", "Ⅿ": "M",
}
SPELT = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "‐": "-", "‑": "-"}
SPACES = "   　"
JOINERS = "‌‍"
SELECTORS = "".join(map(chr, range(0xFE00, 0xFE10)))
INVISIBLE = "­͏؜᠎​‎‏‪‫‬⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿" + JOINERS + SELECTORS


class Node:
    """A state of the transducer: what a path so far becomes, and where each further mark leads."""

    __slots__ = ("target", "marks")

    def __init__(self, target: str | None = None):
        self.target, self.marks = target, {}


class Transducer:
    """The compiled mapping; apply() rewrites a text in one pass."""

    def __init__(self) -> None:
        self.start: dict[str, Node] = {}
        self._path(LOOK_ALIKES | SPELT)

    def _put(self, sign: str, node: Node) -> None:
        if self.start.setdefault(sign, node) is not node:
            raise ValueError(f"{sign!r} has two targets")

    def _node(self, sign: str) -> Node:
        """The node of a sign that stays as it is, or of one that it looks like."""
        if sign not in self.start:
            self.start[sign] = Node(sign)
        return self.start[sign]

    def _path(self, alike: dict[str, str]) -> None:
        for s, t in alike.items():
            self._put(s, self._node(t) if len(t) == 1 else Node(t))
        for s in SPACES:
            self._put(s, self._node(" "))
        every = [chr(n) for n in range(sys.maxunicode + 1) if not 0xD800 <= n <= 0xDFFF]
        how = {c: unicodedata.decomposition(c) for c in every if unicodedata.decomposition(c)}
        for c, d in how.items():
            if d.startswith("<wide>") and c not in SPACES:
                self._put(c, self._node(chr(int(d.split()[1], 16))))
        self.marks: dict[str, int] = {c: unicodedata.combining(c) for c in every if unicodedata.combining(c)}
        self.split = {c: unicodedata.normalize("NFD", c) for c, d in how.items() if not d.startswith("<")}
        syllables = [c for c in every if "가" <= c <= "힣"]
        for c in [*(c for c, d in how.items() if not d.startswith("<")), *syllables]:
            base, *rest = unicodedata.normalize("NFD", c)
            node = self._node(base)
            for m in rest:
                self.marks.setdefault(m, 0)  # a vowel or final of a syllable
                node = node.marks.setdefault(m, Node())
            if node.target is None:
                node.target = self._plain(unicodedata.normalize("NFC", c))
            if c not in self.start:
                self.start[c] = node
            elif self.start[c] is not node and c not in alike:
                raise ValueError(f"{c!r} has two targets")
        for sign, node in list(self.start.items()):
            if node.target is not None and len(node.target) == 1 and self.start.get(node.target, node).target != node.target:
                raise ValueError(f"the target {node.target!r} of {sign!r} isn't its own")

    def _plain(self, composed: str) -> str:
        """The composed sign of a path, over the letter that its base looks like."""
        base, *rest = unicodedata.normalize("NFD", composed)
        own = self._node(base).target or base
        return composed if own == base else unicodedata.normalize("NFC", own + "".join(rest))

    def compile(self) -> Transducer:
        touched = {c for c, n in self.start.items() if n.target != c} - set(self.marks) - set(INVISIBLE)
        self._far = re.compile("[\U00010000-\U0010ffff]")
        self._tables = []
        for top in (0xFFFF, sys.maxunicode):  # sets of signs below 2**16 are looked up at once, others one by one
            marks, hidden, shown = ("".join(re.escape(c) for c in sorted(x) if ord(c) <= top) for x in (self.marks, INVISIBLE, touched))
            plain = f"[{shown}][{hidden}]*|[{hidden}]+"
            self._tables.append((re.compile(f"[{marks}]"), re.compile(plain), re.compile(f"[^{marks}{hidden}](?:[{hidden}]*[{marks}])+[{hidden}]*|[{marks}]+|{plain}")))
        self._cluster = lru_cache(200_000)(self._walk)
        return self

    def _walk(self, cluster: str) -> str:
        """The form of one cluster: the longest path of the trie from its base, then the marks off the path."""
        signs = [c for c in cluster if c not in INVISIBLE]
        base, *rest = signs if len(signs) == 1 else [m for c in signs for m in self.split.get(c, c)]
        node = self.start.get(base)
        if not rest:
            return base if node is None else node.target if node.target is not None else base
        order: list[str] = []
        for m in rest:  # canonical order: marks of different classes by class, stably, between signs of class 0
            i = len(order)
            k = self.marks.get(m, 0)
            while k and i and self.marks.get(order[i - 1], 0) > k:
                i -= 1
            order.insert(i, m)
        if node is None:
            return base + "".join(order)
        best, off, last = node, [], -1
        for m in order:
            k = self.marks.get(m, 0)
            onward = node.marks.get(m) if last < k or not off else None
            if onward is None or (onward.target is None and not onward.marks):
                off.append(m)
                last = k
            else:
                node = onward
                if node.target is not None:
                    best = node
        if best is not node:  # the path ends in no sign of its own
            return unicodedata.normalize("NFC", (self.start[base].target or base) + "".join(order))
        return best.target + "".join(off)

    def apply(self, text: str) -> str:
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        if text.isascii():
            return text
        marks, plain, clusters = self._tables[bool(self._far.search(text))]

        def one(m: re.Match[str]) -> str:
            s = m.group()
            shows = [i for i, c in enumerate(s) if c in JOINERS or c in SELECTORS]
            if shows and any(self._shows(text, m.start() + i) for i in shows):
                return "".join(c if (c in JOINERS or c in SELECTORS) and self._shows(text, m.start() + i) else "" if c in INVISIBLE else self._cluster(c) if c not in self.marks else c for i, c in enumerate(s))
            return self._cluster(s) if s[0] not in INVISIBLE else "".join(c for c in s if c not in INVISIBLE)

        return (clusters if marks.search(text) else plain).sub(one, text)  # most texts have no accents of their own

    @staticmethod
    def _shows(text: str, i: int) -> bool:
        """Whether the joiner or selector at i shows: after a pictograph, a joiner also between Arabic letters."""

        def kind(j: int) -> str:
            while 0 < j < len(text) and text[j] in INVISIBLE and j != i:
                j += 1 if j > i else -1
            n = ord(text[j]) if 0 <= j < len(text) else 0
            return "a" if 0x600 <= n <= 0x8FF and n != 0x61C else "p" if 0x2190 <= n <= 0x2BFF or 0x1F000 <= n <= 0x1FAFF else ""

        if text[i] in SELECTORS:
            return kind(i - 1) == "p"
        return kind(i - 1) == kind(i + 1) != ""


@lru_cache(1)
def transducer() -> Transducer:
    return Transducer().compile()


@pandas_udf(T.StringType())
def one_form(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The consistent form of each text."""
    t = transducer()
    for batch in texts:
        yield batch.map(lambda x: None if x is None else t.apply(x))


def blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)[^\s]")


def classes_of(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The classes of looks, and the documents' membership.

    Classes: form and raw (128-bit hashes of the form and of the string), n (its documents) and links, the number of
    documents of other spellings that look the same: one row for each spelling. Members: doc_id, form, raw. Null and
    blank texts are in no class; a repeated doc_id counts once for each of its texts.
    """
    formed = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null and doc_id is not null")
    formed = formed.withColumn("form", one_form("text"))
    keys = materialize(formed.where(~blank(F.col("form"))).select("doc_id", F.md5("form").alias("form"), F.md5("text").alias("raw")).distinct(), "forms")
    classes = materialize(keys.groupBy("form", "raw").agg(F.count("*").alias("n")), "classes")
    looks = classes.groupBy("form").agg(F.sum("n").alias("_all"), F.count("*").alias("spellings"))
    return hot_join(classes, looks, "form").select("form", "raw", "n", "spellings", (F.col("_all") - F.col("n")).alias("links")), keys


def same_looking(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id_1 < doc_id_2 of documents whose texts have one form but differ as strings.

    Exact copies are one class each; classes are joined within their form, and only then are the pairs given out, as the
    result asks for each document's pairs. Every join is salted by the number of rows of its key. Null and blank texts
    have no pairs; a repeated doc_id is one document.
    """
    classes, keys = classes_of(documents, doc_id, text)
    classes = materialize(classes.where("spellings > 1"), "several-spellings")
    pairs = materialize(hot_join(classes.select("form", "raw", "n"), classes.select("form", F.col("raw").alias("other")), "form").where("raw < other").select("raw", "other", "n"), "class-pairs")
    members = materialize(keys.join(classes.select("form").distinct(), "form", "left_semi").select("doc_id", "raw").distinct(), "members")
    left = materialize(hot_join(members.withColumnRenamed("doc_id", "a"), pairs.drop("n"), "raw").select("a", F.col("other").alias("raw")), "left-members")
    both = hot_join(left, members.withColumnRenamed("doc_id", "b"), "raw")
    return both.select(F.least("a", "b").alias("doc_id_1"), F.greatest("a", "b").alias("doc_id_2")).where("doc_id_1 < doc_id_2").distinct()
