"""Reports along the months of a year."""

from __future__ import annotations

import calendar
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.filters import LedgerFilter
from ledgerlens.functions import labels as L
from ledgerlens.functions.measures import growth_pct, share_pct, sum_where
from ledgerlens.plans.kpi import target_totals
from ledgerlens.schema import GROSS_2_KINDS, REFUND_KIND

MONTHS = range(1, 13)


def monthly_trend(
    ledger: DataFrame,
    targets: DataFrame,
    flt: LedgerFilter,
    target_scope: str = "region",
    as_of_year: int | None = None,
) -> DataFrame:
    """Net per year and month, its running sum, and that sum in percent of the year's target.

    ``target_scope`` is ``region`` for the regional target or ``offices`` for the target of
    the offices the filter chooses.
    """
    if target_scope not in ("region", "offices"):
        raise ValueError("target_scope must be 'region' or 'offices'")
    year = as_of_year or flt.as_of_year
    target = target_totals(targets, flt.offices if target_scope == "offices" else ())
    target = target.select(F.struct("target_cy", "target_py").alias("target")).scalar()
    months = (
        ledger.where(flt.either())
        .groupBy("pay_year", "pay_month")
        .agg(F.sum("nominal").alias("net"))
        .where(F.col("pay_year").isNotNull() & F.col("pay_month").isNotNull())
    )
    to_date = W.partitionBy("pay_year").orderBy("pay_month").rowsBetween(W.unboundedPreceding, 0)
    year_target = F.when(F.col("pay_year") == year, target.getField("target_cy")).when(
        F.col("pay_year") == year - 1, target.getField("target_py")
    )
    report = months.withColumn("cumulative", F.sum("net").over(to_date)).withColumn(
        "cumulative_pct", share_pct(F.col("cumulative"), year_target)
    )
    return report.withColumns(
        {
            "month": L.month_name(F.col("pay_month")),
            "net_label": L.amount_label(F.col("net")),
            "cumulative_label": L.amount_label(F.col("cumulative")),
            "cumulative_pct_label": L.percent_label(F.col("cumulative_pct"), 2),
        }
    ).orderBy(F.col("pay_year").desc(), "pay_month")


def monthly_growth(
    ledger: DataFrame,
    flt: LedgerFilter,
    as_of_year: int | None = None,
    refund_kinds: Sequence[str] = (REFUND_KIND,),
    labels: bool = False,
) -> DataFrame:
    """Growth in percent of gross, net and refunds: a row per measure, a column per month.

    A month counts when both windows have rows in it; every other month, and growth over a
    zero or missing prior amount, is 0. ``refund_kinds`` says which kinds are refunds.
    """
    year = as_of_year or flt.as_of_year
    cy = flt.in_cy() & (F.col("pay_year") == year)
    py = flt.in_py() & (F.col("pay_year") == year - 1)
    measures = {
        "gross": F.col("kind").isin(*GROSS_2_KINDS),
        "net": F.lit(True),
        "refund": F.col("kind").isin(*refund_kinds),
    }
    sums = []
    for name, condition in measures.items():
        for period, rows in (("cy", cy), ("py", py)):
            amount = sum_where(rows, condition)
            amount = F.abs(amount) if name == "refund" else amount
            sums.append(amount.alias(f"{name}_{period}"))
    months = (
        ledger.where(flt.either())
        .groupBy("pay_month")
        .agg(
            *sums,
            F.count(F.when(flt.in_cy(), True)).alias("cy_rows"),
            F.count(F.when(flt.in_py(), True)).alias("py_rows"),
        )
        .where("cy_rows > 0 and py_rows > 0")
    )
    growths = months.select(
        "pay_month",
        *[growth_pct(F.col(f"{m}_cy"), F.col(f"{m}_py")).alias(m) for m in measures],
    )
    cells = growths.agg(
        *[
            F.coalesce(F.max(F.when(F.col("pay_month") == month, F.col(m))), F.lit(0.0)).alias(
                f"{m}_{month}"
            )
            for m in measures
            for month in MONTHS
        ]
    )

    def cell(measure: str, month: int):
        value = F.col(f"{measure}_{month}")
        return L.percent_label(value, 2) if labels else value

    return cells.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(m).alias("growth"),
                        *[cell(m, month).alias(calendar.month_name[month]) for month in MONTHS],
                    )
                    for m in measures
                ]
            )
        )
    )
