"""Headline totals, targets and receipts by kind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.filters import LedgerFilter
from ledgerlens.functions import labels as L
from ledgerlens.functions.measures import (
    growth_or_step,
    growth_or_zero,
    growth_pct,
    gross_ex_refund,
    share_pct,
    sum_where,
)

PERIODS = ("cy", "py")


#: Dimensions with filter options, and whether empty text is no choice.
OPTIONS = {"office": False, "tax_type": False, "sector": False, "segment": True, "payer": True}


def filter_options(ledger: DataFrame) -> DataFrame:
    """Distinct values to choose from per dimension, found in one pass over the ledger.

    Missing values are no choice; empty text is none for segment and payer.
    """
    options = []
    for name, empty_is_missing in OPTIONS.items():
        value = F.nullif(F.col(name), F.lit("")) if empty_is_missing else F.col(name)
        options.append(F.struct(F.lit(name).alias("dimension"), value.alias("value")))
    return (
        ledger.select(F.inline(F.array(*options))).where(F.col("value").isNotNull()).distinct()
    )


def filter_options_of_values(values: DataFrame) -> DataFrame:
    """The same from stored (dimension, value) rows, without the ledger."""
    textual = [name for name, empty_is_missing in OPTIONS.items() if empty_is_missing]
    empty = F.col("dimension").isin(textual) & (F.col("value") == "")
    known = values.where(F.col("dimension").isin(list(OPTIONS)) & F.col("value").isNotNull())
    return known.where(~empty).select("dimension", "value")


def _kpi_row(ledger: DataFrame, flt: LedgerFilter) -> DataFrame:
    """One row with gross, net and net share of both periods.

    The scan is limited by date only: the value lists restrict the numerators, while the
    share is taken of everybody's receipts on the same dates.
    """
    sums = []
    for period in PERIODS:
        dates = flt.in_cy() if period == "cy" else flt.in_py()
        chosen = dates & F.col("_chosen")
        sums += [
            sum_where(chosen, gross_ex_refund()).alias(f"gross_{period}"),
            sum_where(chosen).alias(f"net_{period}"),
            sum_where(dates).alias(f"region_{period}"),
        ]
    # Marked once, since a list may be a table that has to be joined.
    marked = ledger.where(flt.either_dates()).withColumn("_chosen", flt.categories())
    totals = marked.agg(*sums)
    for period in PERIODS:
        totals = totals.withColumn(
            f"share_{period}", F.try_divide(f"net_{period}", f"region_{period}")
        )
    return totals


def kpi_totals(ledger: DataFrame, flt: LedgerFilter) -> DataFrame:
    """Gross without refunds, net, and net as a fraction of the whole ledger, per period."""
    row = _kpi_row(ledger, flt)
    return row.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(period).alias("period"),
                        F.col(f"gross_{period}").alias("gross"),
                        F.col(f"net_{period}").alias("net"),
                        F.col(f"share_{period}").alias("share"),
                    )
                    for period in PERIODS
                ]
            )
        )
    )


def target_totals(targets: DataFrame, offices: Sequence[str] = ()) -> DataFrame:
    """Target of both years for the chosen offices, or for the region when none is chosen.

    Offices without a target count as 0.
    """
    chosen = targets.where(F.col("office").isin(list(offices))) if offices else targets
    totals = chosen.agg(
        *[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in ("target_cy", "target_py")]
    )
    return totals.withColumn(
        "target_growth_pct", growth_pct(F.col("target_cy"), F.col("target_py"))
    )


def kpi_cards(ledger: DataFrame, targets: DataFrame, flt: LedgerFilter) -> DataFrame:
    """The headline row: target, gross, net, share of the region and target attainment."""
    target = target_totals(targets, flt.offices)
    target = target.select(F.struct(*target.columns).alias("target")).scalar()
    zero = F.lit(0)
    row = _kpi_row(ledger, flt).select(
        *[F.coalesce(f"{m}_{p}", zero).alias(f"{m}_{p}") for m in ("gross", "net") for p in PERIODS],
        *[F.coalesce(f"share_{p}", zero.cast("double")).alias(f"share_{p}") for p in PERIODS],
        target.alias("target"),
    )
    gross_cy, gross_py = F.col("gross_cy"), F.col("gross_py")
    net_cy, net_py = F.col("net_cy"), F.col("net_py")
    target_cy, target_py = F.col("target.target_cy"), F.col("target.target_py")
    attainment_cy = share_pct(net_cy, target_cy)
    attainment_py = share_pct(net_py, target_py)
    cards = row.select(
        target_cy.alias("target_cy"),
        target_py.alias("target_py"),
        F.col("target.target_growth_pct"),
        "gross_cy",
        "gross_py",
        (growth_or_step(gross_cy, gross_py) * 100).alias("gross_growth_pct"),
        "net_cy",
        "net_py",
        (growth_or_step(net_cy, net_py) * 100).alias("net_growth_pct"),
        (F.col("share_cy") * 100).alias("share_pct"),
        ((F.col("share_cy") - F.col("share_py")) * 100).alias("share_change"),
        attainment_cy.alias("attainment_pct"),
        (attainment_cy - attainment_py).alias("attainment_change"),
    )
    return cards.withColumns(
        {
            "target_label": L.target_label(F.col("target_cy")),
            "gross_label": L.amount_label(gross_cy),
            "net_label": L.amount_label(net_cy),
            **{
                f"{name}_label": L.percent_label(F.col(f"{name}_pct"), 2)
                for name in ("target_growth", "gross_growth", "net_growth", "share")
            },
            "share_change_label": L.percent_label(F.col("share_change"), 2),
            "attainment_label": L.plain_percent_label(F.col("attainment_pct")),
            "attainment_change_label": L.plain_percent_label(F.col("attainment_change")),
        }
    )


def receipt_kind_yoy(
    ledger: DataFrame, flt: LedgerFilter, as_of_year: int | None = None
) -> DataFrame:
    """Size of the net sum per receipt kind in both years, for kinds of the current window."""
    year = as_of_year or flt.as_of_year
    in_cy, in_py = flt.in_cy(), flt.in_py()
    sums = ledger.where(flt.either()).groupBy("kind").agg(
        F.abs(sum_where(in_cy, F.col("pay_year") == year)).alias("amount_cy"),
        F.abs(sum_where(in_py, F.col("pay_year") == year - 1)).alias("amount_py"),
        F.count(F.when(in_cy, True)).alias("cy_rows"),
    )
    difference = F.col("amount_cy") - F.col("amount_py")
    return sums.where("cy_rows > 0").select(
        "kind",
        "amount_cy",
        "amount_py",
        difference.alias("difference"),
        L.amount_label(F.col("amount_cy")).alias("amount_cy_label"),
        L.amount_label(difference).alias("difference_label"),
    )


def period_delta(ledger: DataFrame, targets: DataFrame, flt: LedgerFilter) -> DataFrame:
    """Current gross without refunds against prior net, and its share of the regional target."""
    target = targets.agg(F.sum("target_cy")).scalar()
    row = ledger.where(flt.either()).agg(
        F.coalesce(sum_where(flt.in_cy(), gross_ex_refund()), F.lit(0)).alias("gross_cy"),
        F.coalesce(sum_where(flt.in_py()), F.lit(0)).alias("net_py"),
    )
    gross_cy, net_py = F.col("gross_cy"), F.col("net_py")
    return row.select(
        "gross_cy",
        "net_py",
        (gross_cy - net_py).alias("difference"),
        (growth_or_zero(gross_cy, net_py) * 100).alias("growth_pct"),
        share_pct(gross_cy, target).alias("target_share_pct"),
        L.target_label(gross_cy, 1).alias("gross_label"),
        L.target_label(net_py, 1).alias("net_py_label"),
        L.target_label(gross_cy - net_py, 1).alias("difference_label"),
    )
