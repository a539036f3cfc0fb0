"""Benchmark decontamination by spaced-seed hashing.

Fixed masks select some of the words in a window and ignore the others. The selected words of
every window of the test items are hashed, and so are those of the training texts; equal
hashes are hits, whatever the ignored words are. Around each hit the two word rows are laid side
by side and the longest stretch is taken in which at least ``min_share`` of the words agree. A
document contains an item if that stretch is at least ``min_words`` words long, or as long as
the item if that is shorter. With the masks below no stretch in which a fifth of the words is
substituted goes without a hit; stretches shorter than 13 words need one more, shorter mask.

A benchmark of one block (``BLOCK_BYTES``) is broadcast with its hashes, and the training texts are
read once and not shuffled, so a passage that a third of the documents share costs no more
than any other. A larger benchmark is cut into blocks and never broadcast: the hashes of both
sides are joined by a shuffle, the training side deduplicated in every text and reduced by a
bitmap of at most ``BITMAP_BITS`` bits, and each different text goes to the blocks in which
it has a hit. There groups of one block and some ``GROUP_BYTES`` of texts are verified.

The hits of a text are verified many at a time as matrices, so items that share a stem cost a
few nanoseconds for each of their words and not a Python call each.

Words are runs of letters, digits and underscores in lower case. Null text counts as empty and
contains nothing, an item without words is contained nowhere. An item of fewer than
``least_words`` words is left out: by default none is, so an item of one word is contained in every text
with that word. Every document row is judged on its own, so repeated rows and null or repeated
ids stay; test items with null id or text are left out. Ids of items may be of any type.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.rows import SLICE, map_rows, map_slices
from ledgerlens.session import written

#: 1: the word counts, 0: any word may stand there (fixed values).
MASKS = ("1101011", "11100011", "1100101001")
#: Added where a stretch of fewer than ``MIN_WORDS`` words is enough (fixed value).
SHORT_MASK = "11011"
MIN_WORDS = 13
MIN_SHARE = 0.8
#: Bytes of test text in one block, and the most items in it.
BLOCK_BYTES = 16 << 20
BLOCK_ITEMS = 200_000
#: Bytes of training text that are verified with one copy of a block.
GROUP_BYTES = 32 << 20
#: Most bits of the map of hashes that the items have (64 MB).
BITMAP_BITS = 1 << 29
#: Hits taken up, and cells of a matrix compared, at a time.
HITS = 1 << 18
CELLS = 1 << 18
#: Shares are exact to this fraction.
_UNIT = 10**6

_WORD = re.compile(r"\w+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_KEY = "__text_key"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _masks_for(size: int, enough: int = MIN_WORDS) -> list[list[int]]:
    """Positions of each mask, cut to a row of ``size`` words of which ``enough`` have to be met."""
    masks = MASKS if min(size, enough) >= MIN_WORDS else (*MASKS, SHORT_MASK)
    cut = {m[:size].rstrip("0") for m in masks}
    return sorted([i for i, c in enumerate(m) if c == "1"] for m in cut)


def _seeds(ids: np.ndarray, positions: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Window starts whose selected words are all known, and the windows' hashes."""
    count = len(ids) - positions[-1]
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    known = ids > 0
    starts = np.flatnonzero(np.logical_and.reduce([known[p : p + count] for p in positions]))
    hashes = np.full(len(starts), len(positions), np.uint64)
    for p in positions:
        hashes = (hashes ^ ids[starts + p].astype(np.uint64)) * _FACTOR
        hashes ^= hashes >> np.uint64(29)
    return starts, hashes


class TestBlock:
    """Hashes and words of some test items, and the search for them in texts."""

    __test__ = False

    def __init__(self, items: Iterable[tuple], min_words: int, min_share: float):
        self.min_words = min_words
        self.loss = round(min_share * _UNIT)
        rows = [(key, words) for key, text in items if (words := words_of(text))]
        self.keys = [key for key, _ in rows]
        vocabulary = sorted({w for _, words in rows for w in words})
        self.word_id = {w: i for i, w in enumerate(vocabulary, 1)}
        self.sizes = np.array([len(words) for _, words in rows], np.int64)
        #: The items' words in one row, and where each item begins.
        self.words = np.array([self.word_id[w] for _, words in rows for w in words], np.int32)
        self.begins = np.cumsum(self.sizes) - self.sizes
        #: For each selection of positions: its sorted hashes and where its entries begin in
        #: ``owners`` and ``places``, the item and start of every entry.
        self.tables: list[tuple[list[int], np.ndarray, int]] = []
        found: dict[tuple[int, ...], list] = {}
        for i, (begin, size) in enumerate(zip(self.begins.tolist(), self.sizes.tolist())):
            ids = self.words[begin : begin + size]
            for positions in _masks_for(size, min_words):
                starts, hashes = _seeds(ids, positions)
                if len(starts):
                    found.setdefault(tuple(positions), []).append((hashes, i, starts))
        owners, places, base = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for positions, parts in found.items():
            hashes = np.concatenate([h for h, _, _ in parts])
            order = np.argsort(hashes, kind="stable")
            owners.append(np.concatenate([np.full(len(x), i) for _, i, x in parts])[order])
            places.append(np.concatenate([x for _, _, x in parts])[order])
            self.tables.append((list(positions), hashes[order], base))
            base += len(hashes)
        self.owners, self.places = np.concatenate(owners), np.concatenate(places)

    def hits(
        self, row: np.ndarray, begins: np.ndarray, done: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Text, item and offset of the item in ``row``, where windows hash alike.

        Some ``HITS`` at a time, in order of the texts; texts marked in ``done`` are passed over.
        """
        starts, entries, times = ([np.zeros(0, np.int64)] for _ in range(3))
        for positions, table, base in self.tables:
            at, hashes = _seeds(row, positions)
            low = np.searchsorted(table, hashes)
            hit = np.flatnonzero(table[np.minimum(low, len(table) - 1)] == hashes)
            starts.append(at[hit])
            entries.append(low[hit] + base)
            times.append(np.searchsorted(table, hashes[hit], "right") - low[hit])
        starts, entries, times = map(np.concatenate, (starts, entries, times))
        order = np.argsort(starts, kind="stable")
        starts, entries, times = starts[order], entries[order], times[order]
        texts = np.searchsorted(begins, starts, "right") - 1
        longest = int(self.sizes.max(initial=0))
        width = len(row) + longest
        cut = np.flatnonzero(np.diff(np.cumsum(times) // HITS)) + 1
        for part in np.split(np.arange(len(starts)), cut):
            part = part[~done[texts[part]]]
            if not len(part):
                continue
            n = times[part]
            entry = np.repeat(entries[part] - np.cumsum(n) + n, n) + np.arange(n.sum())
            owner = self.owners[entry]
            offset = np.repeat(starts[part], n) - self.places[entry]
            # One number for text, item and offset, which may lie before the row.
            code = (np.repeat(texts[part], n) * len(self.keys) + owner) * width + offset + longest
            code, offset = np.divmod(np.unique(code), width)
            text, owner = np.divmod(code, len(self.keys))
            yield text, owner, offset - longest

    def stretches(
        self, row: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray, offset: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of the alignments that hold an item: which, words, agreeing words and start in the text.

        ``low`` and ``high`` are the text's bounds in ``row``.
        """
        start = np.maximum(offset, low)
        width = np.minimum(offset + self.sizes[item], high) - start
        # The widest first, so that a matrix holds rows of like width.
        order = np.argsort(-width, kind="stable")
        done = 0
        while done < len(order):
            wide = int(width[order[done]])
            which = order[done : done + max(1, CELLS // (wide + 1))]
            done += len(which)
            at, n, size = start[which], width[which], self.sizes[item[which]]
            columns = np.arange(wide)
            inside = columns < n[:, None]
            own = (self.begins[item[which]] + at - offset[which])[:, None] + columns
            same = row[np.minimum(at[:, None] + columns, len(row) - 1)]
            same = (same == self.words[np.minimum(own, len(self.words) - 1)]) & inside
            # With sums of (agrees - min_share), a stretch qualifies if its sum is not negative;
            # for each end the leftmost start with a sum no larger is wanted.
            sums = np.zeros((len(which), wide + 1), np.int64)
            np.cumsum(same * _UNIT - self.loss, axis=1, out=sums[:, 1:])
            least = np.minimum.accumulate(sums, axis=1)
            m = self.min_words
            enough = (sums[:, m:] >= least[:, : max(wide + 1 - m, 0)]) & inside[:, m - 1 :]
            whole = (n == size) & (sums[np.arange(len(which)), n] >= 0)
            found = np.flatnonzero(np.where(size < m, whole, enough.any(axis=1)))
            if not len(found):
                continue
            # All rows' searches are one: each row's numbers lie in a range of their own.
            own_range = (np.arange(len(found)) * 2 * _UNIT * (wide + 1))[:, None]
            keys = (own_range - least[found]).ravel()
            first = np.searchsorted(keys, (own_range - sums[found]).ravel(), "left")
            first = first.reshape(len(found), -1) - (np.arange(len(found)) * (wide + 1))[:, None]
            lengths = np.arange(wide + 1) - first
            lengths[:, 1:][~inside[found]] = 0
            end = lengths.argmax(axis=1)
            rows = np.arange(len(found))
            begin, words = first[rows, end], lengths[rows, end]
            gain = sums[found, end] - sums[found, begin]
            agreeing = (gain + self.loss * words) // _UNIT
            yield which[found], words, agreeing, (at - low[which])[found] + begin

    def find(self, texts: list[str | None], any_item: bool = False) -> list[list[tuple]]:
        """For each text (item id, words, agreeing words, first word) of each contained item.

        With ``any_item`` a text's search ends with the first items that are found. The texts are
        searched as one row of words, with gaps that no window spans.
        """
        gap = max(map(len, MASKS))
        rows = [self.ids_of(text) for text in texts]
        begins = np.cumsum([0, *(len(ids) + gap for ids in rows)])
        row = np.zeros(begins[-1], np.int32)
        for begin, ids in zip(begins, rows):
            row[begin : begin + len(ids)] = ids
        ends = begins[1:] - gap
        best: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        done = np.zeros(len(texts), bool)
        for text, item, offset in self.hits(row, begins, done):
            for which, *made in self.stretches(row, begins[text], ends[text], item, offset):
                done[text[which]] |= any_item
                made = (x.tolist() for x in (text[which], item[which], *made))
                for t, i, words, agreeing, first in zip(*made):
                    rank = (words, agreeing, -first)
                    best[t][i] = max(best[t].get(i, rank), rank)
        return [sorted((self.keys[i], w, s, -f) for i, (w, s, f) in b.items()) for b in best]

    def ids_of(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.word_id.get, words, repeat(0)), np.int32, len(words))


class _WordHashes(dict):
    """Hashes of words that need no common vocabulary; forgets them when there are very many."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 20:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word) or 1
        return value

    def seeds(self, text: str | None, selections: list[list[int]]) -> np.ndarray:
        """The different hashes of all windows of a text."""
        ids = np.array([self[w] for w in words_of(text)], np.uint64)
        return np.unique(np.concatenate([_seeds(ids, p)[1] for p in selections])).view(np.int64)


def _items(
    benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int, block_items: int
) -> tuple[DataFrame, int]:
    """(item, text, block) of the usable test items, and the number of blocks."""
    items = benchmark.where(
        F.col(item_col).isNotNull() & F.col(text_col).isNotNull()
    ).select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    total, count = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    blocks = max(-(-(total or 0) // block_bytes), -(-count // block_items))
    # Items are dealt to twice as many blocks as their mean size asks for; the hash deals evenly.
    blocks = blocks if blocks <= 1 else 2 * blocks
    block = F.pmod(F.xxhash64("item", "text"), F.lit(max(blocks, 1))).cast("int")
    return items.distinct().withColumn("block", block), blocks


def _long_enough(items: Iterable[tuple], least_words: int) -> list[tuple]:
    return sorted((key, text) for key, text in items if len(words_of(text)) >= least_words)


def _marked_hashes(hashes: DataFrame):
    """A broadcast map of bits in which the bit of every hash in column seed is set."""
    bits = 1 << 15
    while bits < min(16 * hashes.count(), BITMAP_BITS):
        bits *= 2
    # Bit positions of these functions count from one.
    slot = F.pmod(F.col("seed"), F.lit(bits)) + 1
    pieces = hashes.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("piece")
    )
    marked = np.zeros(bits // 8, np.uint8)
    size = (1 << 15) // 8
    for bucket, piece in pieces.toLocalIterator():
        marked[(bucket - 1) * size : bucket * size] = np.frombuffer(piece, np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(marked)


_NAMES = ("item_id", "words", "agreeing", "first_word")


def _found_type(item_type: str) -> str:
    return f"array<struct<item_id:{item_type},words:int,agreeing:int,first_word:int>>"


def _joined(
    texts: DataFrame,
    items: DataFrame,
    min_words: int,
    min_share: float,
    least_words: int,
    any_item: bool,
) -> DataFrame:
    """(key, items) of the different texts that contain an item, by a join of hashes.

    ``texts`` has a column text, whose MD5 is the key.
    """
    spark = texts.sparkSession
    item_type = items.schema["item"].dataType.simpleString()

    def start_items() -> Callable[..., tuple]:
        hashes = _WordHashes()

        def convert(block, text):
            size = len(words_of(text))
            if not size or size < least_words:
                return block, 0, []
            return block, min(size, MIN_WORDS), hashes.seeds(text, _masks_for(size, min_words))

        return convert

    made, _ = written(
        map_rows(items.select("block", "text"), "block int, size int, seeds array<bigint>", start_items),
        "item-hashes",
    )
    sizes = [r["size"] for r in made.where("size > 0").select("size").distinct().collect()]
    selections = sorted({tuple(p) for size in sizes for p in _masks_for(size, min_words)})
    if not selections:
        return spark.createDataFrame([], f"`{_KEY}` string, items {_found_type(item_type)}")
    seeds, _ = written(made.select("block", F.explode("seeds").alias("seed")).distinct(), "hashes")
    marked = _marked_hashes(seeds.select("seed").distinct())

    def start_texts() -> Callable[..., tuple]:
        hashes, bits = _WordHashes(), marked.value
        positions = [list(p) for p in selections]

        def convert(key, text):
            found = hashes.seeds(text, positions)
            slot = found & (8 * len(bits) - 1)
            return key, len(text.encode()), found[bits[slot >> 3] >> (slot & 7) & 1 > 0]

        return convert

    texts = texts.where(F.col("text").isNotNull()).select(F.md5("text").alias(_KEY), "text")
    hashed = map_rows(texts, f"`{_KEY}` string, size bigint, seeds array<bigint>", start_texts)
    near, _ = written(
        hashed.select(_KEY, "size", F.explode("seeds").alias("seed"))
        .join(seeds, "seed")
        .select(_KEY, "size", "block")
        .distinct(),
        "hits",
    )
    marked.destroy()
    groups = near.groupBy("block").agg(F.ceil(F.sum("size") / GROUP_BYTES).cast("int").alias("groups"))
    some = F.greatest("groups", F.lit(1))
    to_verify = (
        texts.join(near, _KEY)
        .dropDuplicates([_KEY, "block"])
        .join(groups, "block")
        .select("block", F.pmod(F.xxhash64(_KEY), some).cast("int").alias("part"), _KEY, "text")
    )
    copies = items.join(groups, "block").select(
        "block", F.explode(F.sequence(F.lit(0), some - 1)).alias("part"), "item", "text"
    )
    found_type = pa.list_(
        pa.struct(
            [
                ("item_id", copies.limit(0).toArrow().schema.field("item").type),
                *((name, pa.int32()) for name in ("words", "agreeing", "first_word")),
            ]
        )
    )

    def verify(group: pa.Table, own: pa.Table) -> pa.Table:
        rows = zip(own["item"].to_pylist(), own["text"].to_pylist())
        block = TestBlock(_long_enough(rows, least_words), min_words, min_share)
        keys, found = [], []
        for at in range(0, group.num_rows, SLICE):
            part = group.slice(at, SLICE)
            for key, made in zip(part[_KEY].to_pylist(), block.find(part["text"].to_pylist(), any_item)):
                if made:
                    keys.append(key)
                    found.append([dict(zip(_NAMES, x)) for x in made])
        return pa.table({_KEY: pa.array(keys, pa.string()), "items": pa.array(found, found_type)})

    verified = (
        to_verify.groupBy("block", "part")
        .cogroup(copies.groupBy("block", "part"))
        .applyInArrow(verify, f"`{_KEY}` string, items {_found_type(item_type)}")
    )
    return verified.groupBy(_KEY).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )


def _only_block(items: DataFrame, min_words: int, min_share: float, least_words: int):
    """The items of a benchmark of one block, broadcast; Spark frees it with the last user."""
    rows = items.select("item", "text").collect()
    block = TestBlock(_long_enough(map(tuple, rows), least_words), min_words, min_share)
    return items.sparkSession.sparkContext.broadcast(block)


def contained_items(
    docs: DataFrame,
    benchmark: DataFrame,
    min_words: int = MIN_WORDS,
    min_share: float = MIN_SHARE,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    least_words: int = 1,
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """(id, items): for every document the test items it contains and how far; no other columns."""
    items, blocks = _items(benchmark, item_col, item_text_col, block_bytes, block_items)
    found_type = _found_type(items.schema["item"].dataType.simpleString())
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    if not blocks:
        return rows.select(id_col, F.array().cast(found_type).alias("items"))
    if blocks == 1:
        id_type = rows.schema[id_col].dataType.simpleString()
        shared = _only_block(items, min_words, min_share, least_words)

        def start() -> Callable[..., tuple]:
            find = shared.value.find
            return lambda keys, texts: (
                keys,
                [[dict(zip(_NAMES, x)) for x in found] for found in find(texts)],
            )

        return map_slices(rows, f"`{id_col}` {id_type}, items {found_type}", start)
    items, _ = written(items, "items")
    found = _joined(rows.select("text"), items, min_words, min_share, least_words, False)
    return rows.join(found, F.md5("text") == F.col(_KEY), "left").select(
        id_col, F.coalesce("items", F.array().cast(found_type)).alias("items")
    )


def is_contaminated(text: Column, shared) -> Column:
    """Whether a text contains an item of a broadcast block."""

    @F.arrow_udf("boolean")
    def contains(column: pa.Array) -> pa.Array:
        found: list[list] = []
        for at in range(0, len(column), SLICE):
            found += shared.value.find(column.slice(at, SLICE).to_pylist(), True)
        return pa.array(map(bool, found), pa.bool_())

    return contains(text)


def without_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    min_words: int = MIN_WORDS,
    min_share: float = MIN_SHARE,
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    least_words: int = 1,
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """The documents that contain no test item, with all their columns."""
    items, blocks = _items(benchmark, item_col, item_text_col, block_bytes, block_items)
    if not blocks:
        return docs
    if blocks == 1:
        shared = _only_block(items, min_words, min_share, least_words)
        return docs.where(~is_contaminated(F.col(text_col), shared))
    items, _ = written(items, "items")
    texts = docs.select(F.col(text_col).alias("text"))
    found = _joined(texts, items, min_words, min_share, least_words, True).select(_KEY)
    return docs.join(found, F.md5(F.col(text_col)) == F.col(_KEY), "left_anti")
