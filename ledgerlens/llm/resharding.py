"""Resharding that moves the fewest bytes, as a minimum-cost flow.

Documents lie in old shards and are to lie in new ones of given capacities. What each old shard
sends to each new one is the cheapest flow from old sizes to new capacities, where staying costs
nothing and moving costs the same for every byte, or what ``cost`` says. The flow is solved on the
driver: its size is that of the two lists of shards, never of the data.

Documents of an old shard stand in a row of blocks, large documents first; a block holds those
of one order of magnitude whose id hashes alike. The flow cuts that row into stretches, first the
one that stays, and the blocks of a stretch go where the flow says. Small documents stand where
the cuts are, so shards meet their capacities to within a few of them, unless single
documents are larger than a shard.

Only shards whose documents change are rewritten. Sizes are ``extra`` bytes plus the UTF-8 bytes
of the text (null: none). Ids may repeat; rows that repeat an id and a size keep together. A null
id is placed by its text. Other columns are kept in the files.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.dims import local_table
from ledgerlens.session import remove_at_exit, written

#: Blocks that documents of one order of magnitude are dealt to in each old shard.
BINS = 1024
#: Documents that are numbered in one sort, and the bytes they have, at most about.
NUMBERED_TOGETHER = 200_000
NUMBERED_BYTES = 32 << 20
_CUT_COLUMNS = {"o": pa.int32(), "start": pa.int64(), "end": pa.int64(), "shard": pa.int32()}
_STRETCH_COLUMNS = dict.fromkeys(("to_old", "low", "high", "to_shard"), pa.int32())
#: Bytes a document takes besides its text.
EXTRA = 16


class Transfer(NamedTuple):
    old: int
    new: int
    size: int


def capacities(total: int, weights: Mapping[int, float]) -> dict[int, int]:
    """Whole capacities in proportion to the weights that add up to ``total``."""
    whole = sum(weights.values())
    exact = {shard: total * w / whole for shard, w in weights.items()}
    shares = {shard: math.floor(x) for shard, x in exact.items()}
    by_rest = sorted(weights, key=lambda s: (shares[s] - exact[s], s))
    left = total - sum(shares.values())
    for i in range(abs(left)):
        shares[by_rest[i % len(by_rest)]] += 1 if left > 0 else -1
    return shares


def moving_cost(old: int, new: int) -> int:
    return int(old != new)


class _Network:
    """Arcs with room and price, each with its reverse next to it in the lists."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.price: list[int] = []

    def arc(self, a: int, b: int, room: int, price: int) -> int:
        number = len(self.to)
        for at, to, free, paid in ((a, b, room, price), (b, a, 0, -price)):
            self.out[at].append(len(self.to))
            self.to.append(to)
            self.room.append(free)
            self.price.append(paid)
        return number

    def _distances(self, source: int, prices: list[float]) -> list[float]:
        """Least reduced cost from the source to every node."""
        far = [math.inf] * len(self.out)
        far[source] = 0
        heap = [(0, source)]
        while heap:
            reached, at = heapq.heappop(heap)
            if reached > far[at]:
                continue
            for arc in self.out[at]:
                if self.room[arc]:
                    to = self.to[arc]
                    there = reached + self.price[arc] + prices[at] - prices[to]
                    if there < far[to]:
                        far[to] = there
                        heapq.heappush(heap, (there, to))
        return far

    def cheapest_flow(self, source: int, sink: int) -> None:
        """Push all flow there is room for, by the cheapest paths first.

        Each round finds the distances of the residual network, by prices of the nodes that keep
        reduced costs from being negative, and then pushes along all shortest paths at once, so
        there are as many rounds as paths have different costs.
        """
        prices: list[float] = [0] * len(self.out)
        while (far := self._distances(source, prices))[sink] < math.inf:
            prices = [p + min(d, far[sink]) for p, d in zip(prices, far)]
            self._push(source, sink, prices)

    def _push(self, source: int, sink: int, prices: list[float]) -> None:
        """Blocking flow over arcs without reduced cost; a node without a way on is left out."""
        next_arc, closed = [0] * len(self.out), [False] * len(self.out)
        path: list[int] = []
        on_path = {source}
        at = source
        while True:
            if at == sink:
                amount = min(self.room[arc] for arc in path)
                for arc in path:
                    self.room[arc] -= amount
                    self.room[arc ^ 1] += amount
                full = next(i for i, arc in enumerate(path) if not self.room[arc])
                for arc in path[full:]:
                    on_path.discard(self.to[arc])
                at = self.to[path[full] ^ 1]
                del path[full:]
                continue
            arcs = self.out[at]
            while next_arc[at] < len(arcs):
                arc = arcs[next_arc[at]]
                to = self.to[arc]
                if (
                    self.room[arc]
                    and not closed[to]
                    and to not in on_path
                    and self.price[arc] + prices[at] - prices[to] == 0
                ):
                    path.append(arc)
                    on_path.add(to)
                    at = to
                    break
                next_arc[at] += 1
            else:
                if at == source:
                    return
                closed[at] = True
                on_path.discard(at)
                at = self.to[path.pop() ^ 1]


def cheapest_transfers(
    sizes: Mapping[int, int],
    room: Mapping[int, int],
    cost: Callable[[int, int], int] = moving_cost,
) -> list[Transfer]:
    """Minimum-cost flow from the sizes of old shards to the capacities of new ones.

    Where every move costs the same, an arc for staying and one hub for all that moves are enough, so
    the network grows with the number of shards and not of their pairs. Other costs, which must
    not be negative, need an arc for each pair.
    """
    if sum(sizes.values()) != sum(room.values()):
        raise ValueError("capacities must add up to the sizes")
    old, new = sorted(s for s, n in sizes.items() if n), sorted(s for s, n in room.items() if n)
    source, sink, hub, first = 0, 1, 2, 3
    network = _Network(first + len(old) + len(new))
    node_of = {("old", s): first + i for i, s in enumerate(old)}
    node_of |= {("new", s): first + len(old) + i for i, s in enumerate(new)}
    for s in old:
        network.arc(source, node_of["old", s], sizes[s], 0)
    for s in new:
        network.arc(node_of["new", s], sink, room[s], 0)
    direct: dict[tuple[int, int], int] = {}
    leaving: dict[int, int] = {}
    entering: dict[int, int] = {}
    if cost is moving_cost:
        for s in set(old) & set(new):
            direct[s, s] = network.arc(node_of["old", s], node_of["new", s], sizes[s], 0)
        leaving = {s: network.arc(node_of["old", s], hub, sizes[s], 1) for s in old}
        entering = {s: network.arc(hub, node_of["new", s], room[s], 0) for s in new}
    else:
        for a in old:
            for b in new:
                direct[a, b] = network.arc(
                    node_of["old", a], node_of["new", b], sizes[a], cost(a, b)
                )
    network.cheapest_flow(source, sink)
    # What an arc carries is the room of its reverse.
    made = [Transfer(a, b, n) for (a, b), arc in direct.items() if (n := network.room[arc ^ 1])]
    # What leaves through the hub is dealt, in order of shards, to what enters from it.
    wanted = [[b, network.room[arc ^ 1]] for b, arc in entering.items() if network.room[arc ^ 1]]
    for a, arc in leaving.items():
        left = network.room[arc ^ 1]
        while left:
            amount = min(left, wanted[-1][1])
            made.append(Transfer(a, wanted[-1][0], amount))
            left, wanted[-1][1] = left - amount, wanted[-1][1] - amount
            if not wanted[-1][1]:
                wanted.pop()
    return sorted(made)


class Layout(NamedTuple):
    """Where documents go: the flow, and for each old shard the rows of blocks cut by it."""

    transfers: list[Transfer]
    #: (old shard, first block, block after the last, new shard)
    stretches: list[tuple[int, int, int, int]]

    def untouched(self) -> set[int]:
        """Shards that keep all they have and get nothing."""
        stays = {t.old for t in self.transfers if t.old == t.new}
        moves = [t for t in self.transfers if t.old != t.new]
        return stays - {t.old for t in moves} - {t.new for t in moves}


def document_size(text: Column, extra: int = EXTRA) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + extra).cast("long")


def _block(identity: Column, size: Column) -> Column:
    magnitude = F.floor(F.log2(size)).cast("int")
    return (63 - magnitude) * BINS + F.pmod(F.xxhash64(identity, F.lit("block")), F.lit(BINS))


def plan(
    blocks: DataFrame, weights: Mapping[int, float], cost: Callable[[int, int], int] = moving_cost
) -> Layout:
    """The layout for old shards whose ``blocks`` have old, block and size."""
    spark = blocks.sparkSession
    sizes = {r[0]: r[1] for r in blocks.groupBy("old").agg(F.sum("size")).collect()}
    transfers = cheapest_transfers(sizes, capacities(sum(sizes.values()), weights), cost)
    cuts = []
    for old in sizes:
        at = 0
        own = sorted((t for t in transfers if t.old == old), key=lambda t: (t.new != old, t.new))
        for t in own:
            cuts.append((old, at, at + t.size, t.new))
            at += t.size
    if not cuts:
        return Layout([], [])
    stretches = local_table(spark, cuts, _CUT_COLUMNS)
    row = Window.partitionBy("old").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.sum("size").over(row) - F.col("size") / 2
    placed = blocks.withColumn("middle", middle).join(
        stretches,
        (F.col("old") == F.col("o")) & F.col("middle").between(F.col("start"), F.col("end")),
    )
    # A middle that lies on a cut belongs to the stretch before it.
    first = placed.groupBy("old", "block").agg(F.min_by("shard", "start").alias("shard"))
    ends = first.groupBy("old", "shard").agg(F.min("block"), F.max("block")).collect()
    return Layout(transfers, sorted((old, low, high + 1, new) for old, new, low, high in ends))


def _free(name: str, docs: DataFrame) -> str:
    """``name``, with underscores added while the documents have such a column."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def reshard(
    docs: DataFrame,
    old_shard: Column,
    weights: Mapping[int, float] | Sequence[int],
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    cost: Callable[[int, int], int] = moving_cost,
    extra: int = EXTRA,
) -> tuple[DataFrame, Layout]:
    """Rewrite the affected shards below ``path``; the new documents and the layout.

    ``old_shard`` is the number of the shard a row lies in, ``weights`` gives the new shards and
    their shares of the bytes, a list of shards for equal ones. The documents come back with
    shard, slot (gapless from 0 in each shard) and size added; where a name is taken, an
    underscore is added to it. Shards without change are read from where they are.
    """
    if not isinstance(weights, Mapping):
        weights = dict.fromkeys(weights, 1.0)
    spark = docs.sparkSession
    shard, slot, size = (_free(n, docs) for n in ("shard", "slot", "size"))
    text = F.col(text_col)
    identity = F.coalesce(F.col(id_col).cast("string"), text, F.lit(""))
    own_size = document_size(text, extra)
    # One pass over the texts leaves a few numbers per document for all that is counted below.
    placed, _ = written(
        docs.select(
            old_shard.cast("int").alias("old"),
            _block(identity, own_size).cast("int").alias("block"),
            F.xxhash64(identity).alias("hash"),
            own_size.alias("size"),
        ),
        "placed",
    )
    layout = plan(placed.groupBy("old", "block").agg(F.sum("size").alias("size")), weights, cost)
    where = local_table(spark, layout.stretches, _STRETCH_COLUMNS)

    def goes(old: Column, block: Column) -> Column:
        return (old == F.col("to_old")) & (block >= F.col("low")) & (block < F.col("high"))

    # Each shard is numbered in parts of bounded size; a part starts where those before it end.
    count, total = placed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    share = max(weights.values()) / sum(weights.values())
    parts = max(
        1,
        -(-count // (len(weights) * NUMBERED_TOGETHER)),
        math.ceil(total * share / NUMBERED_BYTES),
    )
    part = F.pmod(F.col("hash"), F.lit(parts)).cast("int")
    sizes = placed.join(where, goes(F.col("old"), F.col("block"))).groupBy(
        F.col("to_shard").alias("in_shard"), part.alias("in_part")
    )
    earlier = Window.partitionBy("in_shard").orderBy("in_part")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.count().withColumn("before", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    offsets, _ = written(offsets, "offsets")

    inner = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        old_shard.cast("int").alias("old"),
        _block(identity, own_size).cast("int").alias("block"),
        F.xxhash64(identity).alias("hash"),
        own_size.alias("size"),
    )
    inner = inner.join(where, goes(F.col("old"), F.col("block"))).withColumn("part", part)
    order = Window.partitionBy("to_shard", "part").orderBy("block", "hash")
    numbered = inner.withColumn("number", F.row_number().over(order)).join(
        offsets,
        (F.col("to_shard") == F.col("in_shard")) & (F.col("part") == F.col("in_part")),
    )
    rows = numbered.select(
        "doc.*",
        F.col("to_shard").alias(shard),
        (F.col("before") + F.col("number") - 1).cast("long").alias(slot),
        F.col("size").alias(size),
    )
    untouched = sorted(layout.untouched())
    rows.where(~F.col(shard).isin(untouched)).write.partitionBy(shard).parquet(path)
    remove_at_exit(spark, path)
    back = spark.read.schema(rows.schema).parquet(path).select(rows.columns)
    if untouched:
        back = back.union(rows.where(F.col(shard).isin(untouched)))
    return back, layout
