"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

A text is cut into pieces by a pattern and each piece is merged on its own. The leaves of a
piece's segment tree stand for its bytes: the leaf of a live token's first byte holds the rank of
the pair that this token and the next one would make. An inner node holds the least rank below it,
of equal ranks the leftmost, so the root names the next merge. A merge changes three leaves: those of
the merged token, of the token it swallows, and of its live left neighbour.

Rows are coded one by one inside Arrow batches, without a shuffle.
"""

from __future__ import annotations

import base64
import re
import sys
from collections.abc import Iterator
from functools import lru_cache
from operator import methodcaller

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.llm.common import tidy

MEMO_PIECES = 400_000
MEMO_CHARS = 64  # longer pieces are merged each time they occur
WHOLE_CHARS = 1 << 20  # the pieces of longer texts are not listed, but taken one by one
_PLACE_BITS = 32
_PLACE = (1 << _PLACE_BITS) - 1
_NO_PAIR = 1 << 62


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a token in base 64 and its rank on each line."""
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the vocabulary lacks some single bytes")
    return ranks


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece; a piece that is a token itself is not merged."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    leaves = 1 << max(n - 2, 0).bit_length()
    tree = [_NO_PAIR] * (2 * leaves)
    end, before = list(range(1, n + 1)), list(range(-1, n))

    def pair(at: int) -> int:
        """The key of the token that starts at ``at`` and the next one: rank, then place."""
        after = end[at]
        rank = ranks.get(piece[at : end[after]]) if after < n else None
        return _NO_PAIR if rank is None else rank << _PLACE_BITS | at

    def update(at: int, key: int) -> None:
        node = leaves + at
        tree[node] = key
        while node > 1:
            node >>= 1
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                return
            tree[node] = least

    for at in range(n - 1):
        tree[leaves + at] = pair(at)
    for node in range(leaves - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    while (least := tree[1]) != _NO_PAIR:
        at = least & _PLACE
        swallowed = end[at]
        end[at] = end[swallowed]
        before[end[at]] = at
        if swallowed < n - 1:
            update(swallowed, _NO_PAIR)
        update(at, pair(at))
        if at:
            update(before[at], pair(before[at]))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : end[at]]])
        at = end[at]
    return ids


def _scalars(low: int = 0) -> str:
    """All characters from ``low`` on."""
    return "".join(chr(c) for c in range(low, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)


def _ranges(characters: str) -> str:
    """Ascending ``characters`` as the inside of a character set."""
    points = np.array([ord(c) for c in characters], np.int64)
    first = np.flatnonzero(np.diff(points, prepend=-2) != 1)
    last = np.append(first[1:], len(points)) - 1
    return "".join(f"\\U{points[a]:08x}-\\U{points[b]:08x}" for a, b in zip(first, last))


@lru_cache(maxsize=8)
def spelled_out(pattern: str) -> tuple[str, int]:
    """``pattern`` with the sets of tiktoken in place of its ``\\p{..}``, and the first character for which they differ.

    Libraries follow different versions of Unicode, so they disagree on characters that were assigned lately.
    """
    import regex
    import tiktoken

    every, single, first = _scalars(), {bytes([b]): b for b in range(256)}, sys.maxunicode + 1
    sets = {}
    for name in set(re.findall(r"\\[pP]\{[^}]*\}", pattern)):
        coder = tiktoken.Encoding("set", pat_str=name, mergeable_ranks=single, special_tokens={})
        inside = bytes(coder.encode_ordinary(every)).decode()
        apart = set(inside) ^ set(regex.findall(name, every))
        first = min(first, *map(ord, apart)) if apart else first
        sets[name] = f"[{_ranges(inside)}]" if inside else r"[^\s\S]"
    return re.sub(r"\\[pP]\{[^}]*\}", lambda m: sets[m[0]], pattern), first


class _Memo(dict):
    """Pieces and their ids as bytes; emptied when it is full, which changes no id."""

    def __init__(self, ranks: dict[bytes, int], limit: int):
        self.ranks, self.limit = ranks, limit

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(merge(piece.encode(), self.ranks), "<u4").tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = ids
        return ids


class ByteBpe:
    """Encoder and decoder of one vocabulary and one pattern, as ``spelled_out`` gives it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, spelled: str, differs_from: int, memo_pieces: int = MEMO_PIECES):
        import regex

        self.short, self.long = regex.compile(pattern), regex.compile(spelled, regex.V1)
        if self.short.groups:
            raise ValueError("the pattern may not have groups that capture")
        # the short form is the faster one and as good below the first character that is read differently
        self.late = re.compile(f"[\\U{differs_from:08x}-\\U{sys.maxunicode:08x}]") if differs_from <= sys.maxunicode else None
        self.memo = _Memo(ranks, memo_pieces)
        self.tokens = {rank: token for token, rank in ranks.items()}

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        pattern = self.long if self.late and not text.isascii() and self.late.search(text) else self.short
        if len(text) <= WHOLE_CHARS:
            pieces = pattern.findall(text)
        else:
            pieces = map(methodcaller("group"), pattern.finditer(text))
        return b"".join(map(self.memo.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def _coder(raw: bytes, *pattern) -> ByteBpe:
    """The coder of a Python worker, whose memo serves all tasks that the worker runs."""
    return ByteBpe(read_ranks(raw), *pattern)


def _shared(spark: SparkSession, ranks_path: str):
    """A vocabulary file of the driver, sent to the executors once; its size is that of the vocabulary."""
    with open(ranks_path, "rb") as file:
        raw = file.read()
    read_ranks(raw)
    return spark.sparkContext.broadcast(raw)


def _pattern(pattern: str | None) -> tuple[str, str, int]:
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return pattern, *spelled_out(pattern)


def encode(
    documents: DataFrame, ranks_path: str, *, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit numbers).

    A null text counts as empty: no ids. Characters that ``pattern`` does not match get no id, and
    there are no special tokens: their strings are ordinary text. Ids of documents may be null or repeat; no other column is read.
    A text is coded whole whatever its length; a task holds one Arrow batch.
    """
    docs = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    raw, pattern = _shared(documents.sparkSession, ranks_path), _pattern(pattern)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(raw.value, *pattern)
        for batch in batches:
            ids = [coder.encode(text.as_py()) for text in batch.column("text")]
            counts = pa.array([len(row) // 4 for row in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), counts, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return docs.mapInArrow(tidy(coded), schema)


def decode(encoded: DataFrame, ranks_path: str, *, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """The columns of ``encoded`` and ``into``: the bytes that the ids stand for; null ids give null.

    Bytes and not a string, since ids need not end where a character does. An id outside the vocabulary
    raises, and so does a column ``into`` that is there already.
    """
    if into.lower() in map(str.lower, encoded.columns):
        raise ValueError(f"a column {into} is there already")
    raw, pattern = _shared(encoded.sparkSession, ranks_path), _pattern(None)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(raw.value, *pattern)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col))
            texts = pa.array([coder.decode(row.as_py()) if row.is_valid else None for row in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, into])

    return encoded.mapInArrow(tidy(decoded), T.StructType([*encoded.schema.fields, T.StructField(into, T.BinaryType())]))
