"""Approximate nearest neighbours by collision-counting hashing.

Every vector is projected on ``PROJECTIONS`` random directions, and each projection is kept as one
sorted array. A query opens a window around its own projection in every array; a vector collides
with it in those arrays whose window holds it. The windows grow by virtual rehashing: at
radius R they reach ``HALF_WIDTH`` x R to both sides, whatever was counted at a smaller radius stays
counted, and R grows by ``GROWTH``. A vector with at least ``threshold`` collisions is verified by its
distance on the original vectors. The search ends when k verified vectors lie within R.

A vector at distance R or less collides in each array with probability P(|Z| <= HALF_WIDTH), Z normal,
or more, so the number of its collisions is binomial and the threshold is taken such that it is met
with probability ``SURE``. So each of the k nearest is found with that probability, whatever
the data: vectors all alike far only cost more verifications.

All rows are indexed, in blocks of about ``BLOCK`` rows dealt by hash, each with its own sorted
arrays. Where there are fewer blocks than task slots, a block serves groups of queries in several
tasks. Queries stream past a block in batches. Where there are several blocks, every query first meets
one of them; the distance of its kth neighbour there bounds the radius in all others.

Nearness is the Euclidean distance in double precision, summed in order of the components. Vectors
that are null, empty, zero or hold null or non-finite components take no part, and only vectors of
equal length are compared. Every row is a vector of its own, also under a repeated or null id; a
query does not meet its own row, but it meets rows of the same id. Ties go to the smaller id, null ids
last.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerlens.session import written

K = 10
PROJECTIONS = 64
HALF_WIDTH = 1.0
GROWTH = 1.15
#: Probability to verify a vector that lies within the radius.
SURE = 0.95
#: Rows of a block, and queries that are answered at a time.
BLOCK = 1 << 16
BATCH = 128
SEED = 11


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def threshold(projections: int = PROJECTIONS, sure: float = SURE) -> int:
    """Collisions that a vector within the radius reaches with probability ``sure`` or more."""
    p = math.erf(HALF_WIDTH / math.sqrt(2))
    tail = 0.0
    for hits in range(projections, 0, -1):
        tail += math.comb(projections, hits) * p**hits * (1 - p) ** (projections - hits)
        if tail >= sure:
            return hits
    return 0


def directions(size: int, projections: int = PROJECTIONS) -> np.ndarray:
    """Normal directions, one in a column; the same on every machine."""
    return np.random.default_rng([SEED, size]).normal(size=(size, projections))


class Index:
    """Sorted arrays of the projections of some vectors, and the search in them."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, projections: int, sure: float):
        #: Ascending, so that a smaller position is a smaller row.
        self.rows, self.vectors = rows, vectors
        self.squares = np.einsum("ij,ij->i", vectors, vectors)
        #: Scaled for the projections, so that large components don't overflow.
        self.scale = float(np.abs(vectors).max())
        self.directions = directions(vectors.shape[1], projections)
        projected = (vectors / self.scale) @ self.directions
        order = np.argsort(projected, axis=0, kind="stable")
        count = np.uint16 if len(rows) <= 1 << 16 else np.uint32
        #: Vectors in order of each projection, each vector's place in it, and the projections.
        self.order = np.ascontiguousarray(order.T.astype(count))
        self.place = np.empty_like(self.order)
        for place, line in zip(self.place, self.order):
            place[line] = np.arange(len(rows), dtype=count)
        self.sorted = np.ascontiguousarray(np.take_along_axis(projected, order, axis=0).T)
        self.needed = threshold(projections, sure)

    def distances(self, query: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Distances of the chosen vectors, each summed component by component."""
        total = np.zeros(len(chosen))
        with np.errstate(over="ignore"):
            for column, value in zip(self.vectors[chosen].T, query.tolist()):
                difference = column - value
                total += difference * difference
        return np.sqrt(total)

    def verified(
        self, query: np.ndarray, chosen: np.ndarray, found: np.ndarray, far: np.ndarray, k: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of those found before and the chosen ones."""
        if len(chosen) > 4 * k and self.scale < 1e100:
            # All are measured by a product, whose error is far below the slack; those that it
            # cannot put beyond the kth are measured exactly.
            near = self.squares[chosen] - 2 * (self.vectors[chosen] @ query) + query @ query
            limit = np.partition(near, k - 1)[k - 1]
            limit = min(limit, far[-1] ** 2) if len(far) == k else limit
            chosen = chosen[near <= limit + 1e-9 * (self.squares[chosen] + query @ query)]
        found = np.concatenate([found, chosen])
        far = np.concatenate([far, self.distances(query, chosen)])
        best = np.lexsort((found, far))[:k]
        return found[best], far[best]

    def _start(self, at: np.ndarray, k: int) -> float:
        """A radius whose windows hold some k vectors in half of the arrays."""
        gaps = []
        for line, p in zip(self.sorted, at.tolist()):
            middle = int(line.searchsorted(p))
            part = line[max(0, middle - k) : middle + k]
            gaps.append(np.sort(np.abs(part - p))[min(k, len(part)) - 1])
        return max(float(np.median(gaps)) / HALF_WIDTH, 1e-12)

    def _count(self, counts: np.ndarray, old: list | None, new: list) -> None:
        """Add the collisions of windows that grew from ``old`` to ``new``.

        Where windows grow by little, what entered is counted; where they grow by much, it is
        cheaper to count anew by the places of all vectors.
        """
        old = old or [(low, low) for low, _ in new]
        entered = sum(high - low for low, high in new) - sum(high - low for low, high in old)
        if entered * 32 < self.order.size:
            for line, (was_low, was_high), (low, high) in zip(self.order, old, new):
                counts[line[low:was_low]] += 1
                counts[line[was_high:high]] += 1
            return
        counts[:] = 0
        kind, shifted = self.place.dtype.type, np.empty_like(self.place[0])
        held = np.empty(len(counts), bool)
        for place, (low, high) in zip(self.place, new):
            if high > low:
                # Places below a window wrap around and exceed its width.
                np.subtract(place, kind(low), out=shifted)
                np.less_equal(shifted, kind(high - 1 - low), out=held)
                counts += held.view(np.uint8)

    def search(
        self, row: int, query: np.ndarray, k: int, bound: float = math.inf
    ) -> tuple[np.ndarray, np.ndarray]:
        """Positions and distances of the k nearest found, without ``row`` itself.

        Vectors farther than ``bound`` need not be found.
        """
        size = len(self.rows)
        own = int(np.searchsorted(self.rows, row))
        at = (query / self.scale) @ self.directions
        counts = np.zeros(size, np.uint8)
        fresh = np.ones(size, bool)
        if own < size and self.rows[own] == row:
            fresh[own] = False
        windows = None
        found, far = np.zeros(0, np.int64), np.zeros(0)
        radius = self._start(at, 2 * k)
        while True:
            reach = HALF_WIDTH * radius
            ends = np.stack([at - reach, at + reach], axis=1)
            wider = [tuple(line.searchsorted(e).tolist()) for line, e in zip(self.sorted, ends)]
            self._count(counts, windows, wider)
            windows = wider
            covered = counts >= self.needed if math.isfinite(radius) else fresh
            chosen = np.flatnonzero(covered & fresh)
            if len(chosen):
                fresh[chosen] = False
                found, far = self.verified(query, chosen, found, far, k)
            within = radius * self.scale
            if (len(far) == k and far[-1] <= within) or bound <= within or not fresh.any():
                return found, far
            # Twice as far while fewer than k vectors have half the collisions they need.
            half = np.count_nonzero((counts >= self.needed // 2) & fresh)
            radius *= 2 if half < k else GROWTH


def _searched(rows: DataFrame, k: int, projections: int, sure: float) -> DataFrame:
    """(query, row, score) from partitions sorted by block, where a block's data come first."""
    schema = StructType.fromDDL("query bigint, row bigint, score double")
    arrow_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, data, index = None, [], None
        for batch in batches:
            keys = batch.column("block")
            start = 0
            names = keys.to_pylist()
            kinds = batch.column("is_query").to_pylist()
            while start < batch.num_rows:
                end = start
                while end < len(names) and (names[end], kinds[end]) == (names[start], kinds[start]):
                    end += 1
                part = batch.slice(start, end - start)
                if names[start] != block:
                    block, data, index = names[start], [], None
                if not kinds[start]:
                    data.append((part.column("row").to_numpy(), _matrix(part.column("vector"))))
                elif data or index is not None:
                    if index is None:
                        numbers = np.concatenate([r for r, _ in data])
                        order = np.argsort(numbers)
                        vectors = np.concatenate([v for _, v in data])
                        data = []
                        index = Index(numbers[order], vectors[order], projections, sure)
                    for at in range(0, part.num_rows, BATCH):
                        yield answered(index, part.slice(at, BATCH))
                start = end

    def answered(index: Index, part: pa.RecordBatch) -> pa.RecordBatch:
        queries = part.column("row").to_pylist()
        bounds = part.column("bound").to_pylist()
        columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        for row, vector, bound in zip(queries, _matrix(part.column("vector")), bounds):
            found, far = index.search(row, vector, k, bound)
            for column, values in zip(columns, (np.full(len(found), row), index.rows[found], far)):
                column.append(values)
        arrays = [pa.array(np.concatenate(c), f.type) for c, f in zip(columns, arrow_schema)]
        return pa.RecordBatch.from_arrays(arrays, schema=arrow_schema)

    return rows.mapInArrow(run, schema)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows of doubles."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(vectors), -1)


def _met(points: DataFrame, queries: DataFrame, blocks: int, groups: int) -> DataFrame:
    """Data and queries by block and group of queries, the data first.

    ``queries`` name the blocks they go to; a block's data go to each group of queries.
    """
    own = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("number")
    group = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(groups)).cast("int").alias("group")
    each = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    data = points.select("size", own, each, "row", "vector", F.lit(None).cast("double").alias("bound"))
    asked = queries.select(
        "size", F.explode("numbers").alias("number"), group, "row", "vector", "bound"
    )
    both = data.union(asked).select(
        F.concat_ws("/", "size", "number", "group").alias("block"),
        F.col("bound").isNotNull().alias("is_query"),
        "row",
        "vector",
        "bound",
    )
    both = both.repartitionByRange(blocks * groups, "block")
    return both.sortWithinPartitions("block", "is_query")


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    projections: int = PROJECTIONS,
    sure: float = SURE,
    block_rows: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, id, score): up to k nearest found of every row for which ``is_query`` holds.

    There are 255 projections at most.

    ``is_query`` is an expression over the rows of ``vectors``. Ranks of queries that share
    an id are counted for each of them.
    """
    rows = vectors.where(usable(F.col(vector_col))).select(
        F.col(id_col).alias("id"),
        F.col(vector_col).alias("vector"),
        F.size(vector_col).alias("size"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    # Numbered in order of ids, so that a tie between numbers is a tie between ids.
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    rows = rows.orderBy(F.col("id").asc_nulls_last(), "tie").drop("tie")
    points, _ = written(rows.withColumn("row", F.monotonically_increasing_id()), "points")
    count, slots = points.count(), vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-count // block_rows))
    groups = -(-slots // blocks)
    asking = points.where("asks")
    every = F.sequence(F.lit(0), F.lit(blocks - 1))

    def ask(numbers: Column, queries: DataFrame) -> DataFrame:
        met = _met(points, queries.withColumn("numbers", numbers), blocks, groups)
        return _searched(met, k, projections, sure)

    unbounded = asking.withColumn("bound", F.lit(float("inf")))
    if blocks > 1:
        home = F.array(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
        first = ask(home, unbounded).groupBy("query")
        first = first.agg(F.count("*").alias("n"), F.max("score").alias("most")).where(F.col("n") == k)
        bounds, _ = written(first.select("query", "most"), "bounds")
        bounded = asking.join(bounds, asking["row"] == bounds["query"], "left")
        unbounded = bounded.withColumn("bound", F.coalesce("most", F.lit(float("inf"))))
    found = ask(every, unbounded)
    order = W.partitionBy("query").orderBy("score", "row")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    asked = asking.select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    names = points.select("row", F.col("id").alias(id_col))
    named = best.join(names, "row").join(asked, "query")
    return named.select("query_id", "rank", id_col, "score")
