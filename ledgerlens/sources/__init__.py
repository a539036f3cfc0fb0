from ledgerlens.sources.jdbc import read_ledger_jdbc
from ledgerlens.sources.lattice import LedgerLattice
from ledgerlens.sources.star import star_ledger
from ledgerlens.sources.table import (
    compact_ledger,
    read_ledger,
    read_values,
    replace_months,
    write_ledger,
    write_values,
)

__all__ = [
    "LedgerLattice",
    "compact_ledger",
    "read_ledger",
    "read_ledger_jdbc",
    "read_values",
    "replace_months",
    "star_ledger",
    "write_ledger",
    "write_values",
]
