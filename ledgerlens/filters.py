"""Comparison windows and dimension filters as Spark predicates."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_year_earlier(day: dt.date) -> dt.date:
    """The same calendar day a year before; 29 February becomes 28 February."""
    try:
        return day.replace(year=day.year - 1)
    except ValueError:
        return day.replace(year=day.year - 1, day=28)


def _within(start: dt.date | None, end: dt.date | None) -> Column:
    bounds = []
    if start is not None:
        bounds.append(f"paid_on >= DATE'{start.isoformat()}'")
    if end is not None:
        bounds.append(f"paid_on <= DATE'{end.isoformat()}'")
    return F.expr(" AND ".join(bounds) or "true")


@dataclass(frozen=True)
class LedgerFilter:
    """An inclusive date window plus optional value lists per dimension.

    The current window is ``start``..``end``; the prior window is the same range one
    year earlier. An empty list puts no condition on its dimension.

    A list may also be a DataFrame whose first column has the values, for lists of any length: the
    condition is then a subquery, which Spark runs as a semi join, or as a join that marks the
    rows where a report needs the others as well. A table without rows chooses nothing.
    """

    start: dt.date | None = None
    end: dt.date | None = None
    offices: Sequence[str] | DataFrame = ()
    tax_types: Sequence[str] | DataFrame = ()
    sectors: Sequence[str] | DataFrame = ()
    segments: Sequence[str] | DataFrame = ()
    payers: Sequence[str] | DataFrame = ()

    @classmethod
    def of_year(cls, year: int) -> LedgerFilter:
        """The window of one calendar year."""
        return cls(dt.date(year, 1, 1), dt.date(year, 12, 31))

    @property
    def prior_start(self) -> dt.date | None:
        return one_year_earlier(self.start) if self.start else None

    @property
    def prior_end(self) -> dt.date | None:
        return one_year_earlier(self.end) if self.end else None

    @property
    def as_of_year(self) -> int:
        """The year reported as current: the year the window ends in."""
        if self.end is None:
            raise ValueError("a filter without an end date needs an explicit as_of_year")
        return self.end.year

    def in_cy(self) -> Column:
        """Row lies in the current date window."""
        return _within(self.start, self.end)

    def in_py(self) -> Column:
        """Row lies in the date window one year earlier."""
        return _within(self.prior_start, self.prior_end)

    def _lists(self) -> dict[str, Sequence[str] | DataFrame]:
        """The value lists that put a condition on a column."""
        lists = {
            "office": self.offices,
            "tax_type": self.tax_types,
            "sector": self.sectors,
            "segment": self.segments,
            "payer": self.payers,
        }
        return {n: v for n, v in lists.items() if isinstance(v, DataFrame) or v}

    def columns(self) -> list[str]:
        """Ledger columns the value lists refer to."""
        return list(self._lists())

    def categories(self) -> Column:
        """Row satisfies every non-empty value list."""
        tests = [
            F.col(name).isin(
                values.select(values.columns[0]) if isinstance(values, DataFrame) else list(values)
            )
            for name, values in self._lists().items()
        ]
        return reduce(and_, tests, F.lit(True))

    def either_dates(self) -> Column:
        """Row lies in the current or the prior date window."""
        return self.in_cy() | self.in_py()

    def cy(self) -> Column:
        """Current window and value lists."""
        return self.in_cy() & self.categories()

    def py(self) -> Column:
        """Prior window and value lists."""
        return self.in_py() & self.categories()

    def either(self) -> Column:
        """Both windows and the value lists: the scan predicate of year-over-year reports."""
        return self.either_dates() & self.categories()

    def windows(self) -> list[tuple[dt.date | None, dt.date | None]]:
        """The date ranges covered by both windows, merged where they touch."""
        prior, current = (self.prior_start, self.prior_end), (self.start, self.end)
        if self.start is None or self.end is None:
            return [(prior[0], current[1])]
        if prior[1] >= current[0] - dt.timedelta(days=1):
            return [(prior[0], current[1])]
        return [prior, current]


def restrict_to(ledger: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows whose ``column`` occurs in the first column of ``values``.

    For lists too long for a filter's value lists: a semi join, which broadcasts the list
    when its size allows and shuffles both sides otherwise.
    """
    listed = values.select(F.col(values.columns[0]).alias(column))
    return ledger.join(listed, column, "left_semi")
