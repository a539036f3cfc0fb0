"""Reports joining the ledger with a taxpayer master, and plan figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.filters import LedgerFilter
from ledgerlens.functions import labels as L


def payer_kind_receipts(ledger: DataFrame, master: DataFrame, flt: LedgerFilter) -> DataFrame:
    """Net per payer kind of the taxpayer master; payers without a record form a NULL group.

    The ledger is summed per taxpayer before it meets the master, so a taxpayer with very
    many payments is one row in the join.
    """
    payers = ledger.where(flt.cy()).groupBy("npwp15").agg(F.sum("nominal").alias("net"))
    kinds = master.select("npwp15", "payer_kind")
    return payers.join(kinds, "npwp15", "left").groupBy("payer_kind").agg(F.sum("net").alias("net"))


def plan_vs_actual(plan: DataFrame) -> DataFrame:
    """Plan and actual amounts per month and kind."""
    sums = plan.groupBy("pay_month", "plan_kind").agg(F.sum("amount").alias("amount"))
    return sums.where(
        F.col("pay_month").isNotNull() & F.col("plan_kind").isNotNull()
    ).withColumn("amount_label", L.unit_label(F.col("amount"), "M", 1))
