"""Reports by industry sector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.filters import LedgerFilter
from ledgerlens.functions import labels as L
from ledgerlens.functions.measures import (
    YOY_MEASURES,
    gross2,
    growth_pct,
    share_pct,
    sum_in_period,
    sum_where,
    yoy_sums,
)
from ledgerlens.operators.ranking import average_rank, largest
from ledgerlens.operators.totals import grand_totals

# Sector names that mark a missing classification.
UNCLASSIFIED = ("KLU ERROR", " ")
# Fixed value: caption of the remaining sectors.
OTHER_CAPTION = "LAINNYA"


def _relabel(sums: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace raw sectors by their labels, adding up sectors that share one.

    The ledger is already aggregated here, so the join sees one row per raw sector (and
    key) whatever share of the ledger a sector holds. Sectors without a label drop out.
    """
    named = sums.join(labels, "sector").where(F.col("label").isNotNull())
    return named.groupBy(F.col("label").alias("sector"), *keys).agg(
        *[F.sum(m).alias(m) for m in YOY_MEASURES]
    )


def _with_rises(sums: DataFrame) -> DataFrame:
    gross_cy, gross_py = F.col("gross_cy"), F.col("gross_py")
    return sums.withColumns(
        {
            "rise_gross": gross_cy - gross_py,
            "rise_net": F.col("net_cy") - F.col("net_py"),
            "growth_gross_pct": growth_pct(gross_cy, gross_py),
        }
    )


def sector_totals(ledger: DataFrame, labels: DataFrame, flt: LedgerFilter) -> DataFrame:
    """Net and gross per raw sector with its label; unlabelled sectors keep a NULL label."""
    sums = (
        ledger.where(flt.cy())
        .groupBy("sector")
        .agg(F.sum("nominal").alias("net"), sum_where(gross2()).alias("gross"))
    )
    return (
        sums.join(labels, "sector", "left")
        .select("sector", "label", "net", "gross")
        .orderBy(F.col("gross").asc_nulls_last(), "sector")
    )


def sector_yoy(ledger: DataFrame, labels: DataFrame, flt: LedgerFilter) -> DataFrame:
    """Gross and net of both periods per labelled sector, their rises and gross growth."""
    sums = ledger.where(flt.either()).groupBy("sector").agg(*yoy_sums(flt))
    report = _with_rises(_relabel(sums, labels, ()))
    return report.orderBy(F.col("gross_cy").desc_nulls_last(), "sector")


def sector_payer_yoy(
    ledger: DataFrame, labels: DataFrame, flt: LedgerFilter, ordered: bool = False
) -> DataFrame:
    """:func:`sector_yoy` per payer and labelled sector.

    The label is looked up before the only aggregation, so payers are shuffled once.
    ``ordered`` sorts by current gross, descending, at the price of a range shuffle.
    """
    named = (
        ledger.where(flt.either() & F.col("payer").isNotNull())
        .join(labels, "sector")
        .where(F.col("label").isNotNull())
        .drop("sector")
        .withColumnRenamed("label", "sector")
    )
    report = _with_rises(named.groupBy("payer", "sector").agg(*yoy_sums(flt)))
    if ordered:
        report = report.orderBy(F.col("gross_cy").desc_nulls_last(), "payer", "sector")
    return report


def sector_month_yoy(ledger: DataFrame, labels: DataFrame, flt: LedgerFilter) -> DataFrame:
    """Gross and net of both periods per labelled sector and month."""
    sums = ledger.where(flt.either()).groupBy("sector", "pay_month").agg(*yoy_sums(flt))
    return _relabel(sums.where(F.col("pay_month").isNotNull()), labels, ["pay_month"])


def sector_sparkline(ledger: DataFrame, labels: DataFrame, flt: LedgerFilter) -> DataFrame:
    """Monthly amounts of every sector with 0 for a period without rows."""
    months = sector_month_yoy(ledger, labels, flt)
    return months.fillna(0, list(YOY_MEASURES))


def sector_top10(ledger: DataFrame, labels: DataFrame, flt: LedgerFilter) -> DataFrame:
    """Ten sectors with the largest current net, with their shares of all sectors' gross."""
    sums = ledger.where(flt.either()).groupBy("sector").agg(*yoy_sums(flt))
    sectors = _relabel(sums, labels, ())
    whole = grand_totals(sectors, YOY_MEASURES)
    top = largest(_with_rises(sectors), "net_cy", ["sector"])
    shares = {
        f"share_{period}_pct": share_pct(
            F.col(f"gross_{period}"), whole.getField(f"gross_{period}")
        )
        for period in ("cy", "py")
    }
    captions = {"growth_label": L.percent_label(F.col("growth_gross_pct"), 1)}
    for period in ("cy", "py"):
        captions[f"gross_{period}_label"] = L.amount_label(F.col(f"gross_{period}"), 2)
        captions[f"share_{period}_label"] = L.percent_label(F.col(f"share_{period}_pct"), 1)
    return (
        top.withColumns(shares)
        .withColumns(captions)
        .orderBy(F.col("gross_cy").asc_nulls_last(), "sector")
    )


def sector_daily(ledger: DataFrame, flt: LedgerFilter) -> DataFrame:
    """Gross per day and raw sector."""
    return (
        ledger.where(flt.cy() & gross2())
        .groupBy("paid_on", "sector")
        .agg(F.sum("nominal").alias("gross"))
    )


def klu_contribution(ledger: DataFrame, flt: LedgerFilter) -> DataFrame:
    """Gross per sector and industry code, in billions and in percent of the total."""
    sums = (
        ledger.where(flt.cy() & gross2())
        .groupBy("sector", "klu")
        .agg(F.sum("nominal").alias("gross"))
    )
    whole = grand_totals(sums, ["gross"])
    return (
        sums.withColumn("gross_billions", L.billions(F.col("gross")))
        .withColumn("share_pct", share_pct(F.col("gross"), whole.getField("gross")))
        .withColumn("share_label", L.percent_label(F.col("share_pct"), 2))
        .orderBy(F.col("gross").desc_nulls_last(), "sector", "klu")
    )


def sector_surplus_shortfall(
    ledger: DataFrame, labels: DataFrame, flt: LedgerFilter, rank_by: str = "gross_cy"
) -> DataFrame:
    """Sectors ranked by a measure: all of them, those that rose and those that fell.

    ``side`` is ``all``, ``surplus`` or ``shortfall``; each side is ranked on its own, ties
    share the mean of their places. Sectors are read once and listed on every side they
    belong to.
    """
    if rank_by not in (*YOY_MEASURES, "growth_gross_pct"):
        raise ValueError(f"cannot rank by {rank_by}")
    sums = ledger.where(flt.either()).groupBy("sector").agg(*yoy_sums(flt))
    labelled = _relabel(sums, labels, ())
    whole = grand_totals(labelled, YOY_MEASURES)
    sectors = _with_rises(labelled).withColumn(
        "share_pct", share_pct(F.col("gross_cy"), whole.getField("gross_cy"))
    )
    classified = ~F.col("sector").isin(*UNCLASSIFIED)
    sides = F.array_compact(
        F.array(
            F.lit("all"),
            F.when(classified & (F.col("rise_gross") > 0), "surplus"),
            F.when(classified & (F.col("rise_gross") < 0), "shortfall"),
        )
    )
    return sectors.withColumn("side", F.explode(sides)).withColumn(
        "rank", average_rank(F.col(rank_by), "side")
    )


def sectors_with_other(ledger: DataFrame, labels: DataFrame, flt: LedgerFilter) -> DataFrame:
    """Ten labelled sectors with the largest net and one row with the sum of all others."""
    sums = (
        ledger.where(flt.cy())
        .groupBy("sector")
        .agg(F.sum("nominal").alias("net"), sum_in_period(F.lit(True), gross2()).alias("gross"))
    )
    sectors = (
        sums.join(labels, "sector")
        .where(F.col("label").isNotNull())
        .groupBy(F.col("label").alias("sector"))
        .agg(F.sum("net").alias("net"), F.sum("gross").alias("gross"))
    )
    top = largest(sectors, "net", ["sector"])

    def entry(row_kind: str, sector: Column, sign: int) -> Column:
        return F.struct(
            F.lit(row_kind).alias("row_kind"),
            sector.alias("caption"),
            (F.col("net") * sign).alias("net"),
            (F.col("gross") * sign).alias("gross"),
        )

    other = F.lit(OTHER_CAPTION)
    total = sectors.agg(
        *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in ("net", "gross")]
    ).select(F.inline(F.array(entry("other", other, 1))))
    parts = top.select(
        F.inline(F.array(entry("sector", F.col("sector"), 1), entry("other", other, -1)))
    )
    return (
        parts.unionByName(total)
        .groupBy("row_kind", F.col("caption").alias("sector"))
        .agg(F.sum("net").alias("net"), F.sum("gross").alias("gross"))
    )
