"""The ledger in a relational database, read in parallel date slices."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.filters import LedgerFilter
from ledgerlens.schema import from_legacy_columns


def date_slices(
    flt: LedgerFilter,
    days: int = 31,
    column: str = "paid_on",
    span: tuple[dt.date, dt.date] | None = None,
) -> list[str]:
    """Disjoint SQL conditions that together cover both windows of a filter.

    Each condition becomes one read task, so the date filter runs inside the database. Slices
    are half-open, so a time of day belongs to exactly one of them. A bounded window is cut
    every ``days`` days. A side without a bound is one more slice beyond the first or last
    day of ``span``, the dates the table is known to hold; without ``span`` it is not cut.
    A filter without any dates also reads the rows without a date.
    """
    slices = []
    for start, end in flt.windows():
        first, last = start, end
        if span is not None:
            first, last = start or span[0], end or span[1]
            if start is None and end is not None:
                first = min(first, end + dt.timedelta(days=1))
        elif start is None or end is None:
            first = last = start or end
        if first is None:
            return ["1 = 1"]
        after = last + dt.timedelta(days=1) if end or span else first
        if start is None:
            slices.append(f"{column} < DATE '{first}'")
        lower = first
        while lower < after:
            upper = min(lower + dt.timedelta(days=days), after)
            slices.append(f"{column} >= DATE '{lower}' AND {column} < DATE '{upper}'")
            lower = upper
        if end is None:
            slices.append(f"{column} >= DATE '{max(after, first)}'")
    if flt.start is None and flt.end is None:
        slices.append(f"{column} IS NULL")
    return slices


def weighted_slices(
    counts: Sequence[tuple[dt.date | None, int]],
    parts: int,
    column: str = "paid_on",
    spread: str | None = None,
) -> list[str]:
    """Disjoint SQL conditions for about ``parts`` tasks of like numbers of rows.

    ``counts`` has the rows of each day; None stands for rows without a date. Days follow each
    other in a slice up to the mean number of rows, so a slice holds less than twice the mean unless
    one day does. With ``spread``, a whole-number column, such a day is cut into several slices by
    the remainder of that column; missing values go with remainder 0.
    """
    counts = [(day, rows) for day, rows in counts if rows > 0]
    mean = max(1, -(-sum(rows for _, rows in counts) // max(1, parts)))
    missing = sum(rows for day, rows in counts if day is None)
    slices = []
    run: list[dt.date] = []
    held = 0

    def close() -> None:
        nonlocal held
        if run:
            after = run[-1] + dt.timedelta(days=1)
            slices.append(f"{column} >= DATE '{run[0]}' AND {column} < DATE '{after}'")
        run.clear()
        held = 0

    def cut(condition: str, rows: int) -> None:
        pieces = -(-rows // mean) if spread else 1
        for piece in range(pieces):
            remainder = f"MOD(ABS({spread}), {pieces}) = {piece}"
            if piece == 0:
                remainder = f"({remainder} OR {spread} IS NULL)"
            slices.append(f"{condition} AND {remainder}" if pieces > 1 else condition)

    for day, rows in sorted((c for c in counts if c[0] is not None), key=lambda c: c[0]):
        if held + rows > mean:
            close()
        if rows > mean:
            after = day + dt.timedelta(days=1)
            cut(f"{column} >= DATE '{day}' AND {column} < DATE '{after}'", rows)
            continue
        run.append(day)
        held += rows
    close()
    if missing:
        cut(f"{column} IS NULL", missing)
    return slices or ["1 = 0"]


def count_days(
    spark: SparkSession,
    url: str,
    table: str,
    flt: LedgerFilter,
    properties: dict[str, str] | None = None,
    column: str = "paid_on",
) -> list[tuple[dt.date | None, int]]:
    """Rows of each day in both windows of a filter, counted by the database: a row for each day."""
    windows = " OR ".join(f"({c})" for c in date_slices(flt, days=1 << 20, column=column))
    query = (
        f"SELECT CAST({column} AS DATE) AS day, COUNT(*) AS n FROM {table}"
        f" WHERE {windows} GROUP BY CAST({column} AS DATE)"
    )
    rows = spark.read.jdbc(url, f"({query}) counted", properties=properties or {}).collect()
    return [(r[0], int(r[1])) for r in rows]


def read_ledger_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    flt: LedgerFilter,
    properties: dict[str, str] | None = None,
    days_per_task: int = 31,
    legacy_names: bool = False,
    span: tuple[dt.date, dt.date] | None = None,
    tasks: int | None = None,
    spread: str | None = None,
) -> DataFrame:
    """A database ledger restricted to both windows of a filter, or all of it.

    With ``tasks`` the database first counts its rows by day, and the read is cut into about that many
    slices of like numbers of rows; ``spread`` names a whole-number column that cuts days with
    very many rows. Else every slice has ``days_per_task`` days.

    ``span`` names the first and last day the table is known to hold; with it a read without
    dates runs in parallel too, and rows outside it are still read.
    With ``legacy_names`` the table uses the upper-case column names of an existing
    installation; they are renamed to the ledger schema.
    """
    column = '"DATEBAYAR"' if legacy_names else "paid_on"
    options = {"fetchsize": "10000", **(properties or {})}
    if tasks is None:
        slices = date_slices(flt, days_per_task, column, span)
    else:
        counts = count_days(spark, url, table, flt, options, column)
        slices = weighted_slices(counts, tasks, column, spread)
    rows = spark.read.jdbc(url, table, predicates=slices, properties=options)
    return from_legacy_columns(rows) if legacy_names else rows
