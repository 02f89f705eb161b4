"""Encoding with a public byte-level BPE tokenizer, its merges found by a segment tree.

A text is cut into pieces by the tokenizer's pattern. Over the byte positions of a piece a segment tree holds the rank
of the pair that starts at each live position, and in each node the leftmost least rank. A merge takes the root, joins
the pair to its left part, and updates the ranks at the two live neighbours, each in logarithmic time; so a piece of n
bytes takes O(n log n) whatever it holds. Pieces seen before are taken from a bounded memory.

Null and empty texts have the ids []. Strings of special tokens are ordinary text. Lone surrogates can't occur in
Spark's strings.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern by which the tokenizer cuts a text; a fixed value of it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that are remembered, and their longest length.
REMEMBERED, REMEMBERED_BYTES = 200_000, 64

_NONE = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens with their ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class SegmentTree:
    """Least rank with the leftmost position that has it; keys are rank * size + position, so the least key is both."""

    def __init__(self, ranks: list[int]):
        size = 1
        while size < len(ranks):
            size *= 2
        self.size = size
        nodes = [_NONE] * (2 * size)
        for i, r in enumerate(ranks):
            if r < _NONE:
                nodes[size + i] = r * size + i
        for i in range(size - 1, 0, -1):
            a, b = nodes[2 * i], nodes[2 * i + 1]
            nodes[i] = a if a < b else b
        self.nodes = nodes

    def set(self, i: int, rank: int) -> None:
        nodes, at = self.nodes, self.size + i
        nodes[at] = rank * self.size + i if rank < _NONE else _NONE
        at //= 2
        while at:
            a, b = nodes[2 * at], nodes[2 * at + 1]
            least = a if a < b else b
            if nodes[at] == least:
                break  # nothing changes above
            nodes[at] = least
            at //= 2

    def least(self) -> int:
        """The position of the leftmost least rank, or -1."""
        top = self.nodes[1]
        return -1 if top >= _NONE else top % self.size


class Encoder:
    def __init__(self, path: str = VOCABULARY):
        self.ranks = read_ranks(path)
        self.pattern = regex.compile(PATTERN)
        self.memory: dict[bytes, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        get = ranks.get
        tree = SegmentTree([get(piece[i : i + 2], _NONE) for i in range(n - 1)])
        after = list(range(1, n + 1))  # where the token at a live position ends, and the next live position
        before = list(range(-1, n - 1))
        while (i := tree.least()) >= 0:
            j = after[i]
            end = after[j]
            after[i] = end
            tree.set(j, _NONE) if j < n - 1 else None
            if end < n:
                before[end] = i
                tree.set(i, get(piece[i : after[end]], _NONE))
            else:
                tree.set(i, _NONE)
            if (p := before[i]) >= 0:
                tree.set(p, get(piece[p:end], _NONE))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        memory = self.memory
        for word in self.pattern.findall(text):
            piece = word.encode("utf-8")
            got = memory.get(piece)
            if got is None:
                got = self.merge(piece)
                if len(piece) <= REMEMBERED_BYTES:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    memory[piece] = got
            ids += got
        return ids


_encoders: dict[str, Encoder] = {}


def encoder(path: str = VOCABULARY) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def fingerprint(path: str) -> str:
    """The SHA-256 of a vocabulary file, by which two runs can be told to have used the same one."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def shipped(rows: DataFrame, path: str) -> str:
    """The name under which every executor gets the driver's vocabulary file."""
    rows.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


def encode(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """doc_id and ids of every row."""
    kind = documents.schema[doc_id].dataType
    out = T.StructType([T.StructField(doc_id, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    name = shipped(documents, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(SparkFiles.get(name))
        for b in batches:
            yield pd.DataFrame({doc_id: b[doc_id], "ids": [e.encode(t) for t in b[text]]})

    return documents.select(doc_id, text).mapInPandas(run, out)


def count_tokens(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """The rows without their text, with the number of its tokens as tokens."""
    rest = [f for f in documents.schema.fields if f.name not in (text, "tokens")]
    out = T.StructType([*rest, T.StructField("tokens", T.LongType())])
    names = [f.name for f in rest]
    name = shipped(documents, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(SparkFiles.get(name))
        for b in batches:
            yield b[names].assign(tokens=[len(e.encode(t)) for t in b[text]])

    return documents.select(*names, text).mapInPandas(run, out)
