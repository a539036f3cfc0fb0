"""Reports by tax type and deposit code."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.filters import LedgerFilter
from ledgerlens.functions import labels as L
from ledgerlens.functions.measures import (
    YOY_MEASURES,
    gross2,
    growth_pct,
    share_pct,
    yoy_sums,
)
from ledgerlens.operators.ranking import largest
from ledgerlens.operators.totals import grand_totals

PAYER_KEYS = ("payer", "tax_type", "payer_kind")


def _yoy_by(ledger: DataFrame, flt: LedgerFilter, keys: Sequence[str]) -> DataFrame:
    present = reduce(and_, [F.col(k).isNotNull() for k in keys])
    sums = ledger.where(flt.either() & present).groupBy(*keys).agg(*yoy_sums(flt))
    whole = grand_totals(sums, YOY_MEASURES)
    gross_cy, gross_py = F.col("gross_cy"), F.col("gross_py")
    return sums.select(
        *keys,
        *YOY_MEASURES,
        F.bround(growth_pct(gross_cy, gross_py), 2).alias("growth_pct"),
        F.bround(share_pct(gross_cy, whole.getField("gross_cy")), 2).alias("share_cy_pct"),
        F.bround(share_pct(gross_py, whole.getField("gross_py")), 2).alias("share_py_pct"),
    )


def _top10(report: DataFrame, keys: Sequence[str]) -> DataFrame:
    return largest(report, "gross_cy", keys).withColumn(
        "gross_cy_label", L.unit_label(F.col("gross_cy"), "M", 1)
    )


def tax_type_yoy(ledger: DataFrame, flt: LedgerFilter) -> DataFrame:
    """Gross and net of both periods per tax type, growth and shares of total gross."""
    report = _yoy_by(ledger, flt, ["tax_type"])
    return report.orderBy(F.col("gross_cy").desc_nulls_last(), "tax_type")


def tax_type_payer_yoy(ledger: DataFrame, flt: LedgerFilter, ordered: bool = False) -> DataFrame:
    """:func:`tax_type_yoy` per payer, tax type and payer kind.

    ``ordered`` sorts by current gross, descending, at the price of a range shuffle.
    """
    report = _yoy_by(ledger, flt, PAYER_KEYS)
    if ordered:
        report = report.orderBy(F.col("gross_cy").desc_nulls_last(), *PAYER_KEYS)
    return report


def tax_type_top10(ledger: DataFrame, flt: LedgerFilter) -> DataFrame:
    """Ten tax types with the largest current gross."""
    return _top10(_yoy_by(ledger, flt, ["tax_type"]), ["tax_type"])


def tax_type_payer_top10(ledger: DataFrame, flt: LedgerFilter) -> DataFrame:
    """Ten combinations of payer, tax type and payer kind with the largest current gross."""
    return _top10(_yoy_by(ledger, flt, PAYER_KEYS), PAYER_KEYS)


def deposit_code_contribution(ledger: DataFrame, flt: LedgerFilter) -> DataFrame:
    """Gross per tax type and deposit code, in billions and in percent of the total."""
    sums = (
        ledger.where(flt.cy() & gross2())
        .groupBy("tax_type", "deposit_code")
        .agg(F.sum("nominal").alias("gross"))
    )
    whole = grand_totals(sums, ["gross"])
    return sums.withColumn("gross_billions", L.billions(F.col("gross"))).withColumn(
        "share_pct", share_pct(F.col("gross"), whole.getField("gross"))
    )
