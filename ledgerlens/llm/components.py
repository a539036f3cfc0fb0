"""Connected components of links between numbered nodes.

Alternating star contraction: each round hangs every node's larger neighbours on its smallest
neighbour, then every node and its smaller neighbours on the smallest of them. The links shrink
to stars around each component's smallest node in about log² rounds of joins and sums. Rounds are
cut by written tables in the shared folder, of which only the latest is kept. No node's links
are gathered anywhere: minima are summed up by partial aggregation, and the joins by
node are plain ones whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import remove, written


def _checksum(links: DataFrame) -> tuple:
    sums = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(links.agg(F.count("*"), sums).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link.

    ``a`` and ``b`` are whole numbers. Links may repeat and point either way; links of a node to
    itself and those with a null end are left out. The result reads a table in the shared
    folder and holds one row per linked node, its component's smallest node included.
    """
    spark = links.sparkSession
    edges = (
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    edges, path = written(edges, "links")
    seen = _checksum(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), "m").distinct()
        least = large.groupBy("u").agg(F.min("m").alias("root"))
        small = large.join(least, "u")
        hung = small.select(F.col("m").alias("u"), F.col("root").alias("v")).where("u > v")
        edges, new_path = written(hung.union(least.select("u", "root")).distinct(), "links")
        remove(spark, path)
        path, before, seen = new_path, seen, _checksum(edges)
        if seen == before:
            break
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
