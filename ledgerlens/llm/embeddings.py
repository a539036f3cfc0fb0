"""Near-duplicate vectors by a forest of random-projection trees.

A tree splits a cell of vectors by their projection on a random direction: those below the
median go left, those above go right, and the middle share ``2 * spill`` goes to both, so that
near vectors seldom part. Upper levels are split by Spark: quantiles per cell come from one
aggregation, and cells are split until they hold about ``CELL`` vectors. A task then splits its
cell on down to leaves, compares all pairs within a leaf and verifies each by its cosine in double
precision. Links of all trees are united. A cell that stays large because projections tie is
compared in pairs of blocks, so no size is ever capped.

A cut through a crowd of near vectors parts many of them, whatever the spill. So a cell is no longer
split once a share ``DENSE`` of its pairs are links, as a sample of its vectors tells: all its pairs
are compared, large cells in pairs of blocks. That costs in proportion to the links there are.

Equal vectors are one node of the forest. Vectors that are null, empty, zero or hold null or
non-finite components link with nothing, and only vectors of equal length are compared. Ids may
repeat or be null: each row is a vector of its own, linked with its equals, and a component's id
is its smallest id that is not null.

Recall of a link falls with each level and rises with each tree. Unless the caller names a number
of trees, it follows from the number of vectors: as many as find a pair just at the threshold with
probability ``RECALL``, closer pairs more surely. It grows as a small power of the vectors,
since a tree has a level more each time they double.
"""

from __future__ import annotations

import math
import statistics
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.blocks import block_pairs
from ledgerlens.llm.components import components
from ledgerlens.llm.rows import map_rows
from ledgerlens.session import remove, written

#: Fewest trees, and the probability to find a pair just at the threshold, by which there are more.
TREES = 10
RECALL = 0.95
SPILL = 0.05
#: Vectors in a cell that one task splits on, and in a leaf that is compared pair by pair.
CELL = 8192
LEAF = 256
#: A cell of which this share of pairs are links is not split; vectors sampled to tell.
DENSE = 1 / 128
SAMPLE = 128
#: Vectors of a large dense cell in a block that is compared with another.
BLOCK = 1024
SEED = 7
#: Ends the name of a cell that is not split on.
WHOLE = "="


def usable(vector: Column) -> Column:
    """Whether a vector has a direction."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _directions(tree: int, levels: int, size: int) -> np.ndarray:
    """The directions by which a tree splits its upper levels; the same on every machine."""
    return np.random.default_rng([SEED, tree, size]).normal(size=(levels, size))


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _projected(nodes: DataFrame, trees: int, levels: int) -> DataFrame:
    """(node, cell, p): one row per node and tree with its projection on each upper level."""

    def start() -> Callable[..., tuple]:
        cache: dict[int, np.ndarray] = {}

        def project(node, vector):
            size = len(vector)
            if size not in cache:
                cache[size] = np.concatenate([_directions(t, levels, size) for t in range(trees)])
            unit = _unit(np.array([vector], float))[0]
            return node, size, (cache[size] @ unit).reshape(trees, levels).tolist()

        return project

    schema = "node bigint, size int, p array<array<double>>"
    each = map_rows(nodes.select("node", "vector"), schema, start)
    rows = each.select("node", "size", F.posexplode("p").alias("tree", "p"))
    return rows.select("node", "tree", F.concat_ws("/", "size", "tree").alias("cell"), "p")


def _levels(count: int, size: int, spill: float) -> int:
    """Splits after which cells of ``count`` vectors hold about ``size``."""
    return max(0, math.ceil(math.log(max(count, 1) / size) / -math.log(0.5 + spill)))


def parting_chance(cosine: float, spill: float) -> float:
    """Probability that one split parts two vectors of this cosine, for normal projections.

    One of them lies below the share that goes to both sides and the other one above it.
    """
    normal = statistics.NormalDist()
    edge, width = normal.inv_cdf(0.5 + spill), math.sqrt(max(1 - cosine * cosine, 1e-12))
    step = 1e-3
    below = (-edge - step * (i + 0.5) for i in range(int(6 / step)))
    return 2 * step * sum(normal.pdf(x) * normal.cdf((cosine * x - edge) / width) for x in below)


def trees_for(count: int, min_cosine: float = 0.9, spill: float = SPILL) -> int:
    """Trees that find a pair just at the threshold among ``count`` vectors with ``RECALL``."""
    together = (1 - parting_chance(min_cosine, spill)) ** _levels(count, LEAF, spill)
    if together >= RECALL:
        return TREES
    return max(TREES, math.ceil(math.log(1 - RECALL) / math.log(1 - together)))


def _dense(unit: np.ndarray, min_cosine: float) -> bool:
    """Whether a share ``DENSE`` of the pairs of a few sampled vectors are links."""
    pairs = len(unit) * (len(unit) - 1)
    near = np.count_nonzero(unit @ unit.T >= min_cosine) - len(unit)
    return pairs > 0 and near >= DENSE * pairs


def _dense_cells(
    rows: DataFrame, large: DataFrame, nodes: DataFrame, min_cosine: float
) -> DataFrame:
    """(cell): those of the ``large`` cells that are dense, by a sample of each."""
    sampled = F.pmod(F.xxhash64("cell", "node"), F.col("n")) < SAMPLE
    chosen = rows.join(large.select("cell", "n"), "cell").where(sampled).select("cell", "node")
    chosen = chosen.join(nodes.select("node", "vector"), "node")

    def judge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        unit = _unit(np.stack(group["vector"].to_numpy()).astype(float))
        return pd.DataFrame({"cell": key, "dense": _dense(unit, min_cosine)})

    return chosen.groupBy("cell").applyInPandas(judge, "cell string, dense boolean").where("dense")


def _split(
    rows: DataFrame,
    nodes: DataFrame,
    level: int,
    min_cosine: float,
    spill: float,
    cell_size: int,
) -> DataFrame:
    """Cells larger than ``cell_size`` replaced by their two halves, which overlap.

    Dense ones stay whole: their names get ``WHOLE`` at the end.
    """
    p = F.col("p")[level]
    cuts = rows.groupBy("cell").agg(
        F.count("*").alias("n"), F.percentile_approx(p, [0.5 - spill, 0.5 + spill]).alias("cut")
    )
    cuts = cuts.where((F.col("n") > cell_size) & ~F.endswith("cell", F.lit(WHOLE)))
    cuts, _ = written(cuts, "cuts")
    dense = _dense_cells(rows, cuts, nodes, min_cosine)
    cuts = cuts.join(dense, "cell", "left").select("cell", "cut", "dense")
    sides = F.filter(
        F.array(
            F.when(p <= F.col("cut")[1], F.concat("cell", F.lit("l"))),
            F.when(p >= F.col("cut")[0], F.concat("cell", F.lit("r"))),
        ),
        F.isnotnull,
    )
    split = (
        F.when(F.col("cut").isNull(), F.array("cell"))
        .when(F.col("dense"), F.array(F.concat("cell", F.lit(WHOLE))))
        .otherwise(sides)
    )
    joined = rows.join(cuts, "cell", "left")
    return joined.select("node", "tree", F.explode(split).alias("cell"), "p")


def _leaves(
    unit: np.ndarray, random: np.random.Generator, min_cosine: float, spill: float
) -> Iterator[np.ndarray]:
    """Leaves of a tree over the rows of ``unit``, as row numbers; dense ones may be large."""
    cells = [np.arange(len(unit))]
    while cells:
        cell = cells.pop()
        if len(cell) <= LEAF or _dense(
            unit[random.choice(cell, min(SAMPLE, len(cell)), replace=False)], min_cosine
        ):
            yield cell
            continue
        p = unit[cell] @ random.normal(size=unit.shape[1])
        low, high = np.quantile(p, [0.5 - spill, 0.5 + spill])
        left, right = cell[p <= high], cell[p >= low]
        if max(len(left), len(right)) == len(cell):  # projections tie: no split helps
            yield cell
        else:
            cells += [left, right]


def _leaf_links(
    unit: np.ndarray, leaf: np.ndarray, others: np.ndarray, min_cosine: float
) -> Iterator[np.ndarray]:
    """Pairs of a row number in ``leaf`` and one in ``others`` whose cosine is large enough.

    In strips of rows; of a pair that can stand both ways one is given.
    """
    same = leaf is others
    for at in range(0, len(leaf), LEAF):
        cosines = unit[leaf[at : at + LEAF]] @ unit[others].T
        a, b = np.nonzero(cosines >= min_cosine - 1e-9)
        clear = cosines[a, b] >= min_cosine + 1e-9
        a, b = leaf[a + at], others[b]
        if same:
            a, b, clear = a[a < b], b[a < b], clear[a < b]
        close = np.flatnonzero(~clear)
        clear[close] = np.einsum("ij,ij->i", unit[a[close]], unit[b[close]]) >= min_cosine
        yield np.stack([a[clear], b[clear]], axis=1)


def near_links(
    nodes: DataFrame,
    min_cosine: float = 0.9,
    trees: int | None = None,
    spill: float = SPILL,
    cell_size: int = CELL,
) -> DataFrame:
    """(a, b): linked nodes, each pair once. ``nodes`` has distinct vectors under ``node``."""
    count = nodes.count()
    levels, trees = _levels(count, cell_size, spill), trees or trees_for(count, min_cosine, spill)
    rows, path = written(_projected(nodes, trees, max(levels, 1)), "cells")
    for level in range(levels):
        old = path
        rows, path = written(_split(rows, nodes, level, min_cosine, spill, cell_size), "cells")
        remove(nodes.sparkSession, old)
    rows, whole = rows.select("node", "cell"), F.endswith("cell", F.lit(WHOLE))
    members = block_pairs(rows.where(~whole), ["cell"], F.col("node"), 2 * cell_size).union(
        block_pairs(rows.where(whole), ["cell"], F.col("node"), BLOCK)
    )
    members = members.join(nodes.select("node", "vector"), "node")

    def compare(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group = pd.concat(list(batches), ignore_index=True)
        node, own = group["node"].to_numpy(), group["own"].to_numpy()
        unit = _unit(np.stack(group["vector"].to_numpy()).astype(float))
        cell, low, high = key

        def named(pairs: np.ndarray) -> pd.DataFrame:
            ends = np.sort(node[pairs], axis=1)
            return pd.DataFrame({"a": ends[:, 0], "b": ends[:, 1]})

        if cell.endswith(WHOLE):
            first, second = np.flatnonzero(own == low), np.flatnonzero(own == high)
            for pairs in _leaf_links(unit, first, first if low == high else second, min_cosine):
                yield named(pairs)
            return
        random = np.random.default_rng([SEED, *str(key).encode()])
        links = [np.zeros((0, 2), int)]
        for leaf in _leaves(unit, random, min_cosine, spill):
            for pairs in _leaf_links(unit, leaf, leaf, min_cosine):
                if len(leaf) > LEAF:  # its links may be very many
                    yield named(pairs)
                else:
                    links.append(pairs)
        yield named(np.unique(np.concatenate(links), axis=0))

    links = members.groupBy("cell", "low", "high").applyInPandas(compare, "a bigint, b bigint")
    return links.distinct()


def near_duplicates(
    vectors: DataFrame,
    min_cosine: float = 0.9,
    trees: int | None = None,
    spill: float = SPILL,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(id, n_links, component_id, kept), one row per vector.

    ``n_links`` counts the other rows linked directly, equal vectors included.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    distinct = (
        rows.where(usable(F.col("vector")))
        .groupBy("vector")
        .agg(F.count("*").alias("n"), F.min("id").alias("smallest"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    nodes, _ = written(distinct, "nodes")  # numbers the nodes once and for all
    links, _ = written(near_links(nodes, min_cosine, trees, spill), "vector-links")
    both = links.union(links.select("b", "a"))
    sizes = nodes.select(F.col("node").alias("b"), "n")
    degree = both.join(sizes, "b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("near"))
    named = nodes.join(components(links), "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    ids = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
    known = (
        named.join(ids, "component")
        .join(degree, "node", "left")
        .select(
            F.col("vector").alias("own"),
            (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            "component_id",
        )
    )
    joined = rows.join(known, F.col("vector") == F.col("own"), "left")
    component = F.when(F.col("own").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
