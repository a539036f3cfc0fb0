"""The ledger as a stored Parquet table, laid out by month of payment."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.filters import LedgerFilter
from ledgerlens.session import exists, files_bytes, remove

MONTH_PARTITION = "paid_ym"


def _month_of(day: dt.date) -> int:
    return day.year * 100 + day.month


def _with_month(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn(MONTH_PARTITION, F.year("paid_on") * 100 + F.month("paid_on"))


def _by_month(ledger: DataFrame) -> DataFrame:
    """Rows with their month, dealt to writers by it and sorted by date."""
    return (
        _with_month(ledger)
        .hint("rebalance", MONTH_PARTITION)
        .sortWithinPartitions(MONTH_PARTITION, "paid_on")
    )


def write_ledger(ledger: DataFrame, path: str, mode: str = "error") -> None:
    """Store a ledger partitioned by month of ``paid_on``.

    Rebalancing by month merges small months into few files and splits a month that
    holds a large part of the ledger over several writers. Within a file rows are sorted
    by date, which makes the row-group statistics on ``paid_on`` selective.
    """
    _by_month(ledger).write.partitionBy(MONTH_PARTITION).mode(mode).parquet(path)


#: Bytes of input files for each task that sums and writes, whatever the session's partitions, and
#: such tasks for each piece that a month is dealt to: its files are as many as its pieces at most.
TASK_BYTES, TASKS_A_PIECE = 2 * 1024**2, 32
_PIECE = "paid_ym_piece"


def write_summed(ledger: DataFrame, columns: Sequence[str], path: str) -> None:
    """Store :func:`compact_ledger` of a ledger, laid out as by :func:`write_ledger`.

    For columns of which most rows have a combination of their own: summing before rows move
    would save nothing then. Rows move once, to the writer of their month and of a
    hash of their combination, where they are summed, sorted and written. Writers
    grow with the files the ledger reads, so that what one holds does not.
    """
    spark = ledger.sparkSession
    tasks = -(-files_bytes(spark, ledger.inputFiles()) // TASK_BYTES)
    pieces = max(1, -(-tasks // TASKS_A_PIECE))
    keys = [c for c in columns if c != "nominal"]
    piece = F.pmod(F.xxhash64(*keys), F.lit(pieces)).cast("int")
    dealt = _with_month(ledger.select(*columns)).withColumn(_PIECE, piece)
    summed = (
        dealt.repartition(max(tasks, spark.sparkContext.defaultParallelism), MONTH_PARTITION, _PIECE)
        # Month and piece follow from the keys. Named here, they tell Spark that rows are in place.
        .groupBy(MONTH_PARTITION, _PIECE, *keys)
        .agg(F.sum("nominal").alias("nominal"))
        .select(*keys, "nominal", MONTH_PARTITION)
        .sortWithinPartitions(MONTH_PARTITION, "paid_on")
    )
    summed.write.partitionBy(MONTH_PARTITION).parquet(path)


def replace_months(ledger: DataFrame, path: str, months: Sequence[int]) -> None:
    """Replace the named months (such as 200003) of a stored ledger by the rows of ``ledger``.

    Rows of other months are not taken, and files of other months are not touched. A named month
    without rows is removed. ``ledger`` must not read ``path`` itself. The stored values of
    :func:`write_values`, if there are any, are brought up to date for these months alone.
    """
    spark, months = ledger.sparkSession, sorted(set(months))
    rows = _by_month(ledger).where(F.col(MONTH_PARTITION).isin(months))
    # Columns in the stored order: partitions are overwritten by position.
    stored = spark.read.parquet(path)
    if unknown := set(stored.columns) ^ {*ledger.columns, MONTH_PARTITION}:
        raise ValueError(f"columns differ from the stored ledger: {sorted(unknown)}")
    _replace(rows.select(stored.columns), path, months)
    if exists(spark, f"{path}/{VALUES}"):
        values = spark.read.parquet(f"{path}/{VALUES}")
        dimensions = [r[0] for r in values.select("dimension").distinct().collect()]
        fresh = spark.read.schema(stored.schema).parquet(path)
        fresh = fresh.where(F.col(MONTH_PARTITION).isin(months))
        _replace(_values(fresh, dimensions), f"{path}/{VALUES}", months)


def _replace(rows: DataFrame, path: str, months: Sequence[int]) -> None:
    spark = rows.sparkSession
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(MONTH_PARTITION).parquet(path)
    left = {r[0] for r in rows.select(MONTH_PARTITION).distinct().collect()}
    for month in set(months) - left:
        remove(spark, f"{path}/{MONTH_PARTITION}={month}")


#: Folder of the distinct values below a stored ledger; readers of the ledger pass over it.
VALUES = "_values"


def _values(stored: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    each = [F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dimensions]
    rows = stored.select(MONTH_PARTITION, F.inline(F.array(*each)))
    return rows.where("value is not null").distinct()


def write_values(spark: SparkSession, path: str, dimensions: Sequence[str]) -> None:
    """Store the distinct values of some columns of a stored ledger, month by month."""
    made = _values(spark.read.parquet(path), dimensions).hint("rebalance", MONTH_PARTITION)
    made.write.partitionBy(MONTH_PARTITION).parquet(f"{path}/{VALUES}")


def read_values(spark: SparkSession, path: str, flt: LedgerFilter | None = None) -> DataFrame:
    """(dimension, value): the stored values, united over the months of a filter's windows.

    With a filter these are the values of whole months; no payment is read.
    """
    schema = f"dimension string, value string, {MONTH_PARTITION} int"
    values = spark.read.schema(schema).parquet(f"{path}/{VALUES}")
    if flt is not None:
        values = values.where(month_predicate(flt))
    return values.select("dimension", "value").distinct()


def month_predicate(flt: LedgerFilter, prior: bool = True) -> Column:
    """Partitions that can hold rows of a filter's window, and of the prior one."""
    month = F.col(MONTH_PARTITION)
    ranges = []
    for start, end in flt.windows() if prior else [(flt.start, flt.end)]:
        bounds = []
        if start is not None:
            bounds.append(month >= _month_of(start))
        if end is not None:
            bounds.append(month <= _month_of(end))
        ranges.append(reduce(and_, bounds, F.lit(True)))
    return reduce(or_, ranges)


def read_ledger(
    spark: SparkSession, path: str, flt: LedgerFilter | None = None, prior: bool = True
) -> DataFrame:
    """A stored ledger; with a filter only the month partitions of its windows are read.

    ``prior`` says whether a report needs the window a year earlier as well.
    A Parquet ledger laid out in another way is read as it is.
    """
    ledger = spark.read.parquet(path)
    if flt is not None and MONTH_PARTITION in ledger.columns:
        ledger = ledger.where(month_predicate(flt, prior))
    return ledger.drop(MONTH_PARTITION)


def compact_ledger(ledger: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A smaller ledger of the same meaning: one row per combination of ``columns``.

    Reports depend on a ledger only through sums of ``nominal`` and through which
    combinations occur, so every report that uses no other columns gives the same result on
    the compact ledger. Written once without payer columns it answers all reports by
    sector, tax type, office and month from a table that grows with the days and the code
    lists instead of the payments.
    """
    keys = [c for c in columns if c != "nominal"]
    return ledger.groupBy(*keys).agg(F.sum("nominal").alias("nominal"))
