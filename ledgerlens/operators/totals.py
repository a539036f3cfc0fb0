"""Totals of an aggregate, made available next to its rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.measures import share_pct


def grand_totals(detail: DataFrame, measures: Sequence[str]) -> Column:
    """Sums of ``measures`` over a whole aggregate as a struct for use in expressions.

    The sums are a scalar subquery: no row of ``detail`` moves to reach them. Name every
    measure of ``detail``: the subquery then has the same shuffle as ``detail``, and Spark
    runs that shuffle, and the ledger scan below it, once for both.
    """
    sums = F.struct(*[F.sum(name).alias(name) for name in measures])
    return detail.agg(sums.alias("totals")).scalar()


def with_group_shares(
    detail: DataFrame, measure: str, shares: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Add, per entry of ``shares``, the share in percent of ``measure`` in its key group.

    Group totals are aggregated from ``detail`` and joined back instead of a window over
    the group, so a group holding most of the rows is never sorted inside one task.
    """
    report = detail
    for name, keys in shares.items():
        sums = detail.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
            F.sum(measure).alias("_sum")
        )
        same_keys = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        report = (
            report.join(sums, same_keys, "left")
            .withColumn(name, share_pct(F.col(measure), F.col("_sum")))
            .drop("_sum", *[f"_{k}" for k in keys])
        )
    return report
