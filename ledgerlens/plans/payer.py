"""Reports by taxpayer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.filters import LedgerFilter
from ledgerlens.functions import labels as L
from ledgerlens.functions.measures import gross2, gross4, sum_in_period
from ledgerlens.operators.ranking import largest, rank_bands, smallest

PAYER = ("npwp", "payer")


def _with_payer(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("npwp").isNotNull() & F.col("payer").isNotNull())


def payer_movers(ledger: DataFrame, flt: LedgerFilter) -> DataFrame:
    """Ten payers whose gross rose most and ten whose gross fell most.

    A payer missing in one period has no difference and comes last on either side.
    """
    payers = (
        _with_payer(ledger)
        .where(flt.either() & gross2())
        .groupBy(*PAYER)
        .agg(
            sum_in_period(flt.in_py()).alias("gross_py"),
            sum_in_period(flt.in_cy()).alias("gross_cy"),
        )
        .withColumn("difference", F.col("gross_cy") - F.col("gross_py"))
    )
    difference = F.col("difference")
    top = largest(payers, "difference", PAYER).select(
        F.lit("top").alias("side"),
        F.row_number().over(W.orderBy(difference.desc_nulls_last(), *PAYER)).alias("pos"),
        "*",
    )
    bottom = smallest(payers, "difference", PAYER).select(
        F.lit("bottom").alias("side"),
        F.row_number().over(W.orderBy(difference.asc_nulls_last(), *PAYER)).alias("pos"),
        "*",
    )
    return top.unionByName(bottom).withColumns(
        {
            f"{name}_label": F.format_number(L.billions(F.col(name)), 1)
            for name in ("gross_py", "gross_cy", "difference")
        }
    )


def payer_bands_gross(ledger: DataFrame, flt: LedgerFilter) -> DataFrame:
    """Ten payers with the largest gross including transfers, and the sums of rank bands."""
    payers = (
        ledger.where(flt.cy() & gross4()).groupBy(*PAYER).agg(F.sum("nominal").alias("gross"))
    )
    return rank_bands(payers, rank_by="gross", share_of="gross")


def payer_totals(ledger: DataFrame, flt: LedgerFilter, ordered: bool = False) -> DataFrame:
    """Net and gross per payer.

    ``ordered`` sorts by net, descending, at the price of a range shuffle.
    """
    payers = (
        _with_payer(ledger)
        .where(flt.cy())
        .groupBy(*PAYER)
        .agg(
            F.sum("nominal").alias("net"),
            sum_in_period(F.lit(True), gross2()).alias("gross"),
        )
    )
    return payers.orderBy(F.col("net").desc_nulls_last(), *PAYER) if ordered else payers


def payer_bands_net(ledger: DataFrame, flt: LedgerFilter) -> DataFrame:
    """Ten payers with the largest net, and net and gross sums of rank bands."""
    bands = rank_bands(payer_totals(ledger, flt), rank_by="net", share_of="gross")
    return bands.withColumn("gross_label", L.amount_label(F.col("gross")))


def largest_payers(bands: DataFrame) -> DataFrame:
    """Only the payer rows of a band report, without the sums appended to them."""
    return bands.where(F.col("row_kind") == "payer")
