"""Revenue-ledger reports as lazy Spark DataFrames."""

from ledgerlens.filters import LedgerFilter

__all__ = ["LedgerFilter"]
