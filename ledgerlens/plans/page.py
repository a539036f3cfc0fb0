"""Headline reports of one page from a single pass over the ledger."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from ledgerlens.filters import LedgerFilter
from ledgerlens.plans import kpi, sector, tax_type, trend
from ledgerlens.session import written
from ledgerlens.sources.table import compact_ledger

_BASE = ("paid_on", "nominal", "kind")
#: Reports of the page: the columns each needs and the side tables it takes after the ledger.
_REPORTS: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...], tuple[str, ...]]] = {
    "kpi_totals": (kpi.kpi_totals, (), ()),
    "kpi_cards": (kpi.kpi_cards, (), ("targets",)),
    "period_delta": (kpi.period_delta, (), ("targets",)),
    "receipt_kind_yoy": (kpi.receipt_kind_yoy, ("pay_year",), ()),
    "monthly_trend": (trend.monthly_trend, ("pay_year", "pay_month"), ("targets",)),
    "monthly_growth": (trend.monthly_growth, ("pay_year", "pay_month"), ()),
    "sector_yoy": (sector.sector_yoy, ("sector",), ("labels",)),
    "tax_type_yoy": (tax_type.tax_type_yoy, ("tax_type",), ()),
}
HEADLINE = tuple(_REPORTS)


def page_columns(flt: LedgerFilter, names: Iterable[str] = HEADLINE) -> list[str]:
    """Ledger columns the named reports need under a filter."""
    needed = [c for name in names for c in _REPORTS[name][1]]
    return list(dict.fromkeys([*_BASE, *needed, *flt.columns()]))


def headline_page(
    ledger: DataFrame,
    targets: DataFrame,
    labels: DataFrame,
    flt: LedgerFilter,
    names: Iterable[str] = HEADLINE,
) -> dict[str, DataFrame]:
    """The named reports under one filter, from one aggregate that is computed once.

    The ledger is scanned, restricted to both windows and summed over what the reports and the
    filter's lists tell apart; the sums, by day and code and no longer by payment, are written to
    the shared folder, and every report reads them. Value lists stay with the reports, because shares of
    the whole ledger ignore them.
    """
    names = list(names)
    columns = page_columns(flt, names)
    sums = compact_ledger(ledger.where(flt.either_dates()).select(columns), columns)
    shared, _ = written(sums, "page")
    sides = {"targets": targets, "labels": labels}
    return {
        name: build(shared, *[sides[s] for s in taken], flt=flt)
        for name, (build, _, taken) in ((n, _REPORTS[n]) for n in names)
    }
