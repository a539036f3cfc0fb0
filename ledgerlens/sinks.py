"""Writing finished reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

FORMATS = ("parquet", "csv")


def export_report(
    report: DataFrame,
    path: str,
    fmt: str = "csv",
    mode: str = "error",
    partition_by: Sequence[str] = (),
) -> None:
    """Write a report as CSV with a header line, or as Parquet, in parallel.

    In CSV empty text is a pair of quotes and a missing value is nothing at all; quotes
    inside text are doubled. With ``partition_by`` rows are first rebalanced by those columns,
    so a value gets a few files however many tasks the report has, and a value that holds
    much of the report is split over several writers.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    if partition_by:
        report = report.hint("rebalance", *partition_by)
    writer = report.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.csv(path, header=True, escape='"')
    else:
        writer.parquet(path)
