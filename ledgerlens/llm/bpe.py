"""Byte-level BPE encoding and decoding with a public tokenizer's vocabulary.

A word is held as contiguous arrays: the boundaries of its parts and, beside each boundary,
the rank of merging the two parts that meet there. Merging scans the ranks for the
minimum, deletes that boundary and refreshes the two ranks next to it. The scan is quadratic
in the word's length, so words above :data:`SHORT_WORD` bytes take the same merges from a heap.

Null text counts as empty and gives no ids; the control strings of the vocabulary become
their own ids wherever they stand in a text. Every input row gives one output row, so repeated
rows and null or repeated ids stay; columns other than id and text are not carried along.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.rows import map_rows

#: Pattern by which the vocabulary's tokenizer splits text (fixed value).
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: The same for texts of ASCII characters only, which a plainer expression splits sooner.
_ASCII_PATTERN = (
    r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
)
#: Bytes up to which a word is merged by scanning.
SHORT_WORD = 256
#: Words whose ids a Python worker remembers; the older half goes when there are more.
CACHED_WORDS = 300_000

_NO_MERGE = 1 << 62


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file.

    Printable Latin-1 bytes stand for themselves, the others in order for U+0100 onwards.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Ids, merge ranks and control strings of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*ids.values(), *self.special.values()])
        self.pieces = [b""] * size
        for token, i in ids.items():
            self.pieces[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        self.byte_ids = [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        #: Key: the pair's ids. Value: rank and merged id, so that values order by rank.
        self.merges: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[left], ids[right]] = rank << 32 | ids[left + right]

    def word_ids(self, word: bytes) -> list[int]:
        """Ids of one word after all merges."""
        parts = [self.byte_ids[b] for b in word]
        if len(parts) > SHORT_WORD:
            return self._merge_heap(parts)
        return self._merge_scan(parts)

    def _merge_scan(self, parts: list[int]) -> list[int]:
        rank_of = self.merges.get
        ranks = [rank_of(pair, _NO_MERGE) for pair in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != _NO_MERGE:
            at = ranks.index(least)
            parts[at] = least & 0xFFFFFFFF
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank_of((parts[at], parts[at + 1]), _NO_MERGE)
            if at:
                ranks[at - 1] = rank_of((parts[at - 1], parts[at]), _NO_MERGE)
        return parts

    def _merge_heap(self, parts: list[int]) -> list[int]:
        """The same merges, lowest rank first and leftmost among equals, from a heap."""
        size = len(parts)
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < size:
                rank = self.merges.get((parts[left], parts[right]))
                if rank is not None:
                    heapq.heappush(heap, (rank, left, parts[left], parts[right]))

        for i in range(size - 1):
            offer(i, i + 1)
        while heap:
            rank, left, was_left, was_right = heapq.heappop(heap)
            right = after[left]
            if parts[left] != was_left or right >= size or parts[right] != was_right:
                continue
            parts[left], parts[right] = rank & 0xFFFFFFFF, -1
            after[left] = after[right]
            if after[left] < size:
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [p for p in parts if p >= 0]


class _WordCache(dict):
    """Little-endian ids, as bytes, of words that a Python worker has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = array("I", self.vocabulary.word_ids(word.encode())).tobytes()
        if len(word) <= SHORT_WORD:
            if 2 * len(self) >= CACHED_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


@functools.cache
def _vocabulary(path: str) -> Vocabulary:
    """The vocabulary, loaded once per Python worker."""
    return Vocabulary(path)


@functools.cache
def encoder(path: str) -> Callable[[str | None], np.ndarray]:
    """A function from a text to the array of its ids."""
    vocabulary = _vocabulary(path)
    ids_of = _WordCache(vocabulary).__getitem__
    any_words = regex.compile(PATTERN).findall
    ascii_words = re.compile(_ASCII_PATTERN, re.ASCII).findall
    special = vocabulary.special
    cut = re.compile("|".join(map(re.escape, special)) or r"(?!)")

    def pieces(text: str) -> bytes:
        words = ascii_words(text) if text.isascii() else any_words(text)
        return b"".join(map(ids_of, words))

    def encode(text: str | None) -> np.ndarray:
        chunks, start = [], 0
        text = text or ""
        for found in cut.finditer(text):
            chunks += pieces(text[start : found.start()]), special[found[0]].to_bytes(4, "little")
            start = found.end()
        chunks.append(pieces(text[start:]))
        return np.frombuffer(b"".join(chunks), "<u4")

    return encode


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every whole text."""
    rows = docs.select(id_col, text_col)
    id_type = rows.schema[id_col].dataType.simpleString()

    def start() -> Callable[..., tuple]:
        ids_of = encoder(path)
        return lambda key, text: (key, ids_of(text).astype("<i4"))

    return map_rows(rows, f"`{id_col}` {id_type}, ids array<int>", start)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, ids_sha256, decoded_sha256): encoded and decoded again in one crossing to Python.

    SHA-256 in lowercase hex of the ids as little-endian unsigned 32-bit integers, and of the decoded
    text in UTF-8.
    """
    rows = docs.select(id_col, text_col)
    id_type = rows.schema[id_col].dataType.simpleString()

    def start() -> Callable[..., tuple]:
        ids_of, pieces = encoder(path), _vocabulary(path).pieces

        def convert(key, text):
            ids = ids_of(text)
            whole = _text(ids.tolist(), pieces).encode()
            digests = (hashlib.sha256(x).hexdigest() for x in (ids.astype("<u4").tobytes(), whole))
            return key, ids.astype("<i4"), *digests

        return convert

    schema = f"`{id_col}` {id_type}, ids array<int>, ids_sha256 string, decoded_sha256 string"
    return map_rows(rows, schema, start)


def _text(ids: Iterable[int], pieces: Sequence[bytes]) -> str:
    """Text of ids; unpaired bytes become U+FFFD."""
    return b"".join([pieces[i] for i in ids]).decode("utf-8", "replace")


def decoded(ids: Column, path: str) -> Column:
    """Text of an array of ids, control strings included; unpaired bytes become U+FFFD."""

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        pieces = _vocabulary(path).pieces
        return pa.array([_text(row.as_py() or (), pieces) for row in column], pa.string())

    return decode(ids)
