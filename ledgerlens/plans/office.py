"""Reports by tax office and account officer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.filters import LedgerFilter
from ledgerlens.functions import labels as L
from ledgerlens.functions.measures import (
    gross2,
    gross_ex_refund,
    growth_pct,
    share_pct,
    sum_in_period,
    sum_where,
)
from ledgerlens.operators.totals import grand_totals, with_group_shares
from ledgerlens.schema import PLACEHOLDER_PREFIX

# Offices left out of the per-office payer comparison and of officer shares.
LARGE_OFFICES = ("007", "097")
NO_OFFICER_OFFICES = ("006",)


def office_attainment(ledger: DataFrame, targets: DataFrame, flt: LedgerFilter) -> DataFrame:
    """Net of both periods per office with a target, attainment and growth against targets."""
    chosen = targets.where(F.col("office").isin(list(flt.offices))) if flt.offices else targets
    realised = (
        ledger.where(flt.either())
        .groupBy("office")
        .agg(
            sum_in_period(flt.in_py()).alias("net_py"),
            sum_in_period(flt.in_cy()).alias("net_cy"),
        )
    )
    report = realised.join(chosen, "office").select(
        "office",
        "target_cy",
        "target_py",
        "net_py",
        "net_cy",
        share_pct(F.col("net_cy"), F.col("target_cy")).alias("attainment_pct"),
        share_pct(F.col("net_cy") - F.col("net_py"), F.col("target_py")).alias("growth_pct"),
    )
    return report.withColumns(
        {
            f"{name}_label": L.unit_label(F.col(name), "M", 2)
            for name in ("target_cy", "target_py", "net_py", "net_cy")
        }
        | {
            f"{name}_label": L.percent_label(F.col(f"{name}_pct"), 2)
            for name in ("attainment", "growth")
        }
    )


def office_attainment_mean(ledger: DataFrame, targets: DataFrame, flt: LedgerFilter) -> DataFrame:
    """Mean attainment and mean growth over the offices."""
    return office_attainment(ledger, targets, flt).agg(
        F.avg("attainment_pct").alias("mean_attainment_pct"),
        F.avg("growth_pct").alias("mean_growth_pct"),
    )


def top10_payers_per_office(
    ledger: DataFrame, flt: LedgerFilter, as_of_year: int | None = None
) -> DataFrame:
    """The ten payers with the largest gross of the year in every office, and their growth.

    One scan covers both windows. The rank limit is applied to the payers of an office
    before they are shuffled by office, so a large office never fills one task.
    """
    year = as_of_year or flt.as_of_year
    payers = (
        ledger.where(flt.either() & gross2() & ~F.col("npwp15").startswith(PLACEHOLDER_PREFIX))
        .groupBy("npwp15", "payer", "office")
        .agg(
            sum_where(F.col("pay_year") == year).alias("cy"),
            sum_where(F.col("pay_year") == year - 1).alias("py"),
        )
        .where(F.col("cy").isNotNull())
    )
    by_size = W.partitionBy("office").orderBy(F.col("cy").desc(), "npwp15", "payer")
    return (
        payers.withColumn("rank", F.row_number().over(by_size))
        .where(F.col("rank") <= 10)
        .withColumn("growth_pct", growth_pct(F.col("cy"), F.col("py")))
    )


def top10_payers_cluster(
    ledger: DataFrame,
    flt: LedgerFilter,
    as_of_year: int | None = None,
    excluded_offices: Sequence[str] = LARGE_OFFICES,
) -> DataFrame:
    """:func:`top10_payers_per_office` without some offices, with the means as reference point.

    The means run over the listed rows, at most ten per office, so one task suffices.
    """
    office = F.col("office")
    listed = top10_payers_per_office(ledger, flt, as_of_year)
    kept = listed.where(~office.isin(list(excluded_offices)) | office.isNull())
    all_listed = W.partitionBy()
    return kept.withColumns(
        {
            "mean_cy": F.avg("cy").over(all_listed),
            "mean_growth_pct": F.avg("growth_pct").over(all_listed),
        }
    )


def officer_contribution(
    ledger: DataFrame,
    year: int,
    excluded_offices: Sequence[str] = NO_OFFICER_OFFICES,
) -> DataFrame:
    """Gross without refunds per account officer and its share of section, office and region.

    The year of a payment is that of its date, so the dates of the year limit the scan.
    Sections are compared by name alone, so offices using the same section name share
    one denominator.
    """
    rows = ledger.where(LedgerFilter.of_year(year).in_cy() & gross_ex_refund())
    if excluded_offices:
        rows = rows.where(~F.col("office").isin(list(excluded_offices)))
    officers = rows.groupBy("office", "section", "officer").agg(F.sum("nominal").alias("gross"))
    whole = grand_totals(officers, ["gross"])
    shares = with_group_shares(
        officers,
        "gross",
        {"section_share_pct": ["section"], "office_share_pct": ["office"]},
    )
    return shares.withColumn("region_share_pct", share_pct(F.col("gross"), whole.getField("gross")))
