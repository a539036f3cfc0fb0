"""Node and link tables of two-sided flow diagrams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def flow_nodes(links: DataFrame, source: str, target: str, values: Sequence[str]) -> DataFrame:
    """Distinct labels of both sides, numbered from 0: sources first, missing label last.

    ``links`` is an aggregate over two code lists, so the numbered set is the labels of
    those lists, not ledger rows. ``values`` names its measures: they ride along to keep
    the shuffle of ``links`` identical to the one the link table uses.
    """
    labels = links.select(
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("side_no"), F.col(source).alias("label"), *values),
                F.struct(F.lit(1).alias("side_no"), F.col(target).alias("label"), *values),
            )
        )
    )
    by_label = W.orderBy("side_no", F.col("label").asc_nulls_last())
    return (
        labels.groupBy("side_no", "label")
        .agg(F.count(F.lit(1)).alias("_links"))
        .select(
            (F.row_number().over(by_label) - 1).alias("node"),
            F.when(F.col("side_no") == 0, "source").otherwise("target").alias("side"),
            "label",
        )
    )


def flow_links(
    links: DataFrame,
    source: str,
    target: str,
    values: Sequence[str],
    without_source: str | None = None,
) -> DataFrame:
    """Add the node number of both ends; a label used on both sides is two nodes.

    Links leaving the node labelled ``without_source`` are left out. The test is on the
    node, not on the link: as a condition on ``links`` it would reach the ledger scan of
    the links but not that of the nodes, and the two could not share a shuffle.
    """
    nodes = flow_nodes(links, source, target, values)
    for side, column in (("source", source), ("target", target)):
        end = nodes.where(F.col("side") == side).select(
            F.col("node").alias(f"{side}_node"), F.col("label").alias(f"{side}_label")
        )
        links = links.join(end, F.col(column).eqNullSafe(F.col(f"{side}_label")), "left")
    if without_source is not None:
        links = links.where(~F.col("source_label").eqNullSafe(F.lit(without_source)))
    return links.drop("source_label", "target_label")
