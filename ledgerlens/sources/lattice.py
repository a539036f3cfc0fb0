"""Stored ledgers of several grains, and the choice of the smallest one that serves a report.

A report depends on a ledger only through the columns it names. So a ledger summed over more columns
than that gives the same report from fewer rows, and the reports of a page, whatever their filters,
need the payments only once: when the grains are stored.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.filters import LedgerFilter
from ledgerlens.sources.table import (
    MONTH_PARTITION,
    compact_ledger,
    read_ledger,
    replace_months,
    write_ledger,
    write_summed,
)

#: Columns that every grain has: the months it is stored by, the measures' conditions, the amount.
ALWAYS = ("paid_on", "kind", "nominal")
_CATALOGUE = "grains"


@dataclass(frozen=True)
class Grain:
    """One stored ledger: the columns it is summed over and its number of rows."""

    name: str
    columns: frozenset[str]
    rows: int


class LedgerLattice:
    """Grains of one ledger below a folder, with a table of what they hold."""

    def __init__(self, spark: SparkSession, root: str, grains: Sequence[Grain]):
        self.spark, self.root, self.grains = spark, root, tuple(grains)

    @classmethod
    def store(
        cls, ledger: DataFrame, root: str, grains: Mapping[str, Iterable[str]]
    ) -> LedgerLattice:
        """Sum a ledger to every grain and write them, each by month.

        The finest come first, and each is summed from the smallest stored one that covers it, so
        the ledger itself is read only for grains that no other covers. Those are summed where they
        are written, the rest before their rows move.
        """
        made = cls(ledger.sparkSession, root, ())
        wanted = {name: {*ALWAYS, *columns} for name, columns in grains.items()}
        for name in sorted(wanted, key=lambda n: (-len(wanted[n]), n)):
            columns = [c for c in ledger.columns if c in wanted[name]]
            if missing := wanted[name] - set(columns):
                raise ValueError(f"the ledger lacks {sorted(missing)} of grain {name!r}")
            covering = made._covering(wanted[name])
            if covering:
                source = made.read(covering[0].name).select(columns)
                write_ledger(compact_ledger(source, columns), made.path(name))
            else:
                write_summed(ledger, columns, made.path(name))
            rows = made.read(name).count()  # from the files' footers
            made.grains += (Grain(name, frozenset(wanted[name]), rows),)
        made._write_catalogue()
        return made

    def _write_catalogue(self) -> None:
        rows = [(g.name, sorted(g.columns), g.rows) for g in self.grains]
        table = self.spark.createDataFrame(rows, "name string, columns array<string>, rows bigint")
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{_CATALOGUE}")

    def refresh(self, ledger: DataFrame, months: Sequence[int]) -> None:
        """Replace the named months in every grain by the rows that ``ledger`` has of them.

        Each grain is summed from a finer one that has been refreshed, as in :meth:`store`; files of
        other months are not touched.
        """
        fresh: list[Grain] = []
        for grain in sorted(self.grains, key=lambda g: (-len(g.columns), g.name)):
            finer = sorted((g for g in fresh if grain.columns <= g.columns), key=lambda g: g.rows)
            source = ledger
            if finer:
                # A filter on the months alone: only their files are read.
                source = self.spark.read.parquet(self.path(finer[0].name))
                source = source.where(F.col(MONTH_PARTITION).isin(list(months)))
            columns = [c for c in ledger.columns if c in grain.columns]
            summed = compact_ledger(source.select(columns), columns)
            replace_months(summed, self.path(grain.name), months)
            fresh.append(Grain(grain.name, grain.columns, self.read(grain.name).count()))
        self.grains = tuple(fresh)
        self._write_catalogue()

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> LedgerLattice:
        """The grains that were stored below ``root``."""
        rows = spark.read.parquet(f"{root}/{_CATALOGUE}").collect()
        return cls(spark, root, [Grain(r["name"], frozenset(r["columns"]), r["rows"]) for r in rows])

    def path(self, name: str) -> str:
        return f"{self.root}/grain={name}"

    def read(
        self, name: str, flt: LedgerFilter | None = None, prior: bool = True
    ) -> DataFrame:
        return read_ledger(self.spark, self.path(name), flt, prior)

    def _covering(self, columns: Iterable[str]) -> list[Grain]:
        """Grains that have all these columns, the smallest first."""
        needed = {*ALWAYS, *columns}
        return sorted(
            (g for g in self.grains if needed <= g.columns), key=lambda g: (g.rows, g.name)
        )

    def route(self, columns: Iterable[str], flt: LedgerFilter | None = None) -> Grain:
        """The grain with the fewest rows that has a report's columns and those of its filter."""
        needed = {*columns, *(flt.columns() if flt else ())}
        if covering := self._covering(needed):
            return covering[0]
        raise ValueError(f"no stored grain has all of {sorted(needed)}")

    def ledger(
        self, columns: Iterable[str], flt: LedgerFilter | None = None, prior: bool = True
    ) -> DataFrame:
        """The routed grain, of which only the months of the filter's windows are read."""
        return self.read(self.route(columns, flt).name, flt, prior)

    def values(self, columns: Iterable[str]) -> DataFrame:
        """(dimension, value): the distinct values of each column, each from its smallest grain."""
        parts = [
            self.ledger([c]).select(F.lit(c).alias("dimension"), F.col(c).alias("value")).distinct()
            for c in columns
        ]
        made = parts[0]
        for part in parts[1:]:
            made = made.union(part)
        return made.where("value is not null")
