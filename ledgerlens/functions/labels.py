"""Display strings for amounts, percentages and months."""

from __future__ import annotations

import calendar

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit suffixes and the amounts above which they apply.
UNITS = [("T", 1e12), ("M", 1e9), ("Jt", 1e6)]


def amount_label(amount: Column, places: int = 3) -> Column:
    """Amount in the largest unit it exceeds, for example ``1.250T``; plain below a million."""
    size = F.abs(amount)
    label = None
    for suffix, unit in UNITS:
        text = F.concat(F.format_number(amount / F.lit(unit), places), F.lit(suffix))
        label = F.when(size > unit, text) if label is None else label.when(size > unit, text)
    return label.otherwise(F.format_number(amount, 0))


def target_label(amount: Column, places: int = 2) -> Column:
    """Amount in trillions when above one trillion, else in billions."""
    return F.when(amount > 1e12, unit_label(amount, "T", places)).otherwise(
        unit_label(amount, "M", places)
    )


def unit_label(amount: Column, suffix: str, places: int) -> Column:
    """Amount in one fixed unit."""
    return F.concat(F.format_number(amount / F.lit(dict(UNITS)[suffix]), places), F.lit(suffix))


def billions(amount: Column) -> Column:
    """Amount in billions."""
    return amount / F.lit(1e9)


def percent_label(value: Column, places: int) -> Column:
    """Percentage with a percent sign."""
    return F.concat(F.format_number(value, places), F.lit("%"))


def plain_percent_label(value: Column) -> Column:
    """Percentage with two places and no thousands separator."""
    return F.when(value.isNotNull(), F.format_string("%.2f%%", value))


def month_name(month: Column) -> Column:
    """English month name for 1..12, NULL otherwise."""
    names = F.array(*[F.lit(name) for name in calendar.month_name[1:]])
    return F.get(names, month.cast("int") - 1)
