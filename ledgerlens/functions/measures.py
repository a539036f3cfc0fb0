"""Amount measures: gross and net sums per period, growth and share expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.filters import LedgerFilter
from ledgerlens.schema import GROSS_2_KINDS, GROSS_4_KINDS, REFUND_KIND

YOY_MEASURES = ("gross_py", "gross_cy", "net_py", "net_cy")


def gross2() -> Column:
    """Receipts only: the two receipt kinds."""
    return F.col("kind").isin(*GROSS_2_KINDS)


def gross4() -> Column:
    """Receipts and transfers in both directions."""
    return F.col("kind").isin(*GROSS_4_KINDS)


def gross_ex_refund() -> Column:
    """Everything but refunds."""
    return F.col("kind") != REFUND_KIND


def sum_where(*conditions: Column) -> Column:
    """Sum of ``nominal`` over rows meeting all conditions; NULL when there is none."""
    test = conditions[0]
    for condition in conditions[1:]:
        test = test & condition
    return F.sum(F.when(test, F.col("nominal")))


def sum_in_period(period: Column, condition: Column | None = None) -> Column:
    """Sum of ``nominal`` in a period, told apart from an absent period.

    NULL when the group has no row in the period, 0 when it has rows but none of them
    meets the condition.
    """
    nominal = F.col("nominal")
    if condition is None:
        return F.sum(F.when(period, nominal))
    return F.sum(F.when(period & condition, nominal).when(period, F.lit(0)))


def yoy_sums(flt: LedgerFilter) -> list[Column]:
    """Gross and net of both periods as one list of aggregates, named as in YOY_MEASURES."""
    in_cy, in_py = flt.in_cy(), flt.in_py()
    return [
        sum_in_period(in_py, gross2()).alias("gross_py"),
        sum_in_period(in_cy, gross2()).alias("gross_cy"),
        sum_in_period(in_py).alias("net_py"),
        sum_in_period(in_cy).alias("net_cy"),
    ]


def growth_pct(current: Column, prior: Column) -> Column:
    """Change against the prior amount in percent; NULL for a zero or missing prior."""
    return F.try_divide(current - prior, prior) * 100


def growth_or_step(current: Column, prior: Column) -> Column:
    """Relative change that is defined for a zero prior: 1 if the amount appeared, else 0."""
    return (
        F.when(prior != 0, F.try_divide(current - prior, prior))
        .when(current > 0, F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


def growth_or_zero(current: Column, prior: Column) -> Column:
    """Relative change, 0 for a zero prior or no change at all."""
    return F.when((prior == 0) | (current == prior), F.lit(0.0)).otherwise(
        F.try_divide(current - prior, prior)
    )


def share_pct(part: Column, whole: Column) -> Column:
    """Part of a whole in percent; NULL when the whole is zero or missing."""
    return F.try_divide(part, whole) * 100
