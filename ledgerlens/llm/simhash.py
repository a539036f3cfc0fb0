"""SimHash near-duplicates with pigeonring filtering.

A text's words are its runs of characters other than space and U+0009 to U+000D, with A-Z in lower
case. Every shingle of consecutive words is hashed by XXH64; a bit of the fingerprint is set if
it is set in over half the hashes. Two fingerprints link at ``max_bits`` or fewer differing bits.

For ``k = max_bits`` a fingerprint is a ring of ``k + 1`` segments. If two differ in at most k
bits, then from some segment on every chain of l consecutive segments differs in at most
``l * k / (k + 1)`` bits, rounded down: none in the first, at most one in the first two, two in
the first three, and so on. The first two budgets give the join key: the whole first segment and
three of the four quarters of the next, one key for each first segment and omitted quarter.
Fingerprints with the same key are compared chain by chain, so most are pruned before the
last chain, which is the full Hamming distance.

Equal fingerprints are one node, however many copies there are. A key shared by many fingerprints
is cut into blocks, all pairs of blocks are compared, and a pair of blocks gives the links
of a spanning forest only, so links stay in proportion to fingerprints. No pair is lost.

Null text counts as empty: fingerprint zero, linked like any other. Ids may repeat or be null; a
component's id is its smallest id that is not null.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.blocks import block_pairs
from ledgerlens.llm.components import components
from ledgerlens.llm.rows import map_rows
from ledgerlens.session import written

BITS = 64
SEED = 42
#: Fingerprints of one key that are compared in one piece.
BLOCK = 512
_QUARTERS = 4


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of one whole text."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    majority = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(majority.view("<u8")[0])


def fingerprints(
    docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, fp): the fingerprint of every document, as a signed 64-bit number."""
    rows = docs.select(id_col, text_col)
    id_type = rows.schema[id_col].dataType.simpleString()

    def start() -> Callable[..., tuple]:
        signed = 1 << BITS - 1
        return lambda key, text: (key, (fingerprint(text, shingle) ^ signed) - signed)

    return map_rows(rows, f"`{id_col}` {id_type}, fp bigint", start)


def _bounds(max_bits: int) -> list[int]:
    return [BITS * i // (max_bits + 1) for i in range(max_bits + 2)]


def _bits(fp: Column, start: int, end: int) -> Column:
    return F.shiftrightunsigned(fp, start).bitwiseAND((1 << end - start) - 1)


def ring_keys(fp: Column, max_bits: int) -> Column:
    """Array of join keys: a segment, its successor less one quarter, and which those are."""
    bounds, keys = _bounds(max_bits), []
    segments = max_bits + 1
    for first in range(segments):
        second = (first + 1) % segments
        start, end = bounds[second], bounds[second + 1]
        cuts = [start + (end - start) * q // _QUARTERS for q in range(_QUARTERS + 1)]
        for q in range(_QUARTERS):
            key, used = F.lit(first * _QUARTERS + q).cast("bigint"), 0
            kept = [(bounds[first], bounds[first + 1]), (start, cuts[q]), (cuts[q + 1], end)]
            for low, high in kept:
                if high > low:
                    key = F.shiftleft(key, high - low).bitwiseOR(_bits(fp, low, high))
                    used += high - low
            keys.append(F.struct(F.lit(first).alias("first"), key.alias("key")))
    return F.array(*keys)


def _near(fps: np.ndarray, first: int, max_bits: int) -> np.ndarray:
    """Which pairs keep every budget of the chain that starts at segment ``first``."""
    bounds, segments = _bounds(max_bits), max_bits + 1
    differing = fps[:, None] ^ fps[None, :]
    spent = np.zeros(differing.shape, np.uint8)
    alive = np.ones(differing.shape, bool)
    for length in range(1, segments + 1):
        at = (first + length - 1) % segments
        mask = np.uint64(((1 << bounds[at + 1] - bounds[at]) - 1) << bounds[at])
        spent += np.bitwise_count(differing & mask)
        alive &= spent <= length * max_bits // segments
        if not alive.any():
            break
    return alive


def _forest(near: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that connect whatever ``near`` connects."""
    left = np.ones(len(near), bool)
    for seed in range(len(near)):
        if not left[seed]:
            continue
        left[seed], reached = False, [seed]
        while reached:
            u = reached.pop()
            new = np.flatnonzero(near[u] & left)
            left[new] = False
            for v in new.tolist():
                yield u, v
                reached.append(v)


def near_links(distinct: DataFrame, max_bits: int = 3, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect all fingerprints within ``max_bits`` of each other.

    ``distinct`` has one row per fingerprint ``fp``.
    """
    if not 0 < max_bits < 32:
        raise ValueError("max_bits must lie between 1 and 31")
    keyed = distinct.select("fp", F.explode(ring_keys(F.col("fp"), max_bits)).alias("k")).select(
        "fp", "k.first", "k.key"
    )
    placed = block_pairs(keyed, ["key"], F.col("fp"), block)
    groups = (
        placed.groupBy("key", "first", "low", "high")
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select("first", "fps")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links: list[tuple[int, int]] = []
            for first, fps in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = fps.values.to_numpy()
                near = _near(own.view(np.uint64), first, max_bits)
                if near.sum() > len(own):
                    links += [(own[u], own[v]) for u, v in _forest(near)]
            ends = list(zip(*links)) or [(), ()]
            yield pa.RecordBatch.from_pydict(
                {n: pa.array(e, pa.int64()) for n, e in zip(("a", "b"), ends)}
            )

    return groups.mapInArrow(compare, "a bigint, b bigint")


def _parts(prints: DataFrame, max_bits: int) -> DataFrame:
    """(fp, component): each fingerprint and the one that names its component."""
    distinct = prints.select("fp").distinct()
    parts = components(near_links(distinct, max_bits))
    named = distinct.join(parts, F.col("fp") == F.col("node"), "left")
    return named.select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(
    docs: DataFrame,
    shingle: int = 3,
    max_bits: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, fp, component_id): each document's fingerprint and its component's smallest id."""
    prints, _ = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min(id_col).alias("smallest"))
    named = distinct.join(_parts(prints, max_bits), "fp")
    ids = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
    by_print = named.join(ids, "component").select("fp", "component_id")
    return prints.join(by_print, "fp").select(id_col, "fp", "component_id")


def one_of_each(
    docs: DataFrame,
    shingle: int = 3,
    max_bits: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The documents less all near-duplicates but one of each component.

    Rows are judged by their texts: the row with the smallest id stays, null ids last, of equal
    ids the one whose text has the smallest MD5 (null text as empty). Rows alike in both are copies, of
    which any one stays. So rows that share an id but not their text are judged apart.
    """
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    tag = uuid.uuid4().hex
    key, text, print_of = f"key_{tag}", f"text_{tag}", f"print_{tag}"
    marked = docs.select(F.col(id_col).alias(key), digest.alias(text), F.col(text_col).alias(print_of))
    mark = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col(text).alias("text"))
    marked = marked.select(mark.alias("mark"), F.col(print_of).alias("whole"))
    prints, _ = written(fingerprints(marked, shingle, "mark", "whole"), "fingerprints")
    # Tables of their own, so that the join can split a fingerprint that very many rows share.
    rows, _ = written(prints.groupBy("fp", "mark").agg(F.count("*").alias("n")), "rows")
    parts, _ = written(_parts(prints, max_bits), "parts")
    named, _ = written(rows.join(parts, "fp"), "marks")
    best = named.groupBy("component").agg(F.min("mark").alias("best"))
    judged = named.join(best, "component").select(
        F.col("mark.id").alias(key),
        F.col("mark.text").alias(text),
        (F.col("mark") == F.col("best")).alias("stays"),
        "n",
    )
    judged, _ = written(judged, "judged")
    same = F.col(id_col).eqNullSafe(F.col(key)) & (digest == F.col(text))
    kept = docs.join(judged.where(~F.col("stays")), same, "left_anti")
    kept = kept.select([F.col(f"`{c}`") for c in docs.columns])
    repeated = judged.where("stays and n > 1")
    if repeated.isEmpty():
        return kept
    # Rows alike in id and text: only these are brought together.
    again = kept.join(repeated, same, "left_semi").withColumn(text, digest)
    again = again.dropDuplicates([id_col, text]).drop(text)
    return kept.join(repeated, same, "left_anti").union(again)
