"""Reports below the sector level, and flows between dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.filters import LedgerFilter
from ledgerlens.functions.measures import gross2, growth_pct, sum_in_period
from ledgerlens.operators.flow import flow_links, flow_nodes

HIERARCHY = ("sector", "subsector", "klu")
MEASURES = ("gross_py", "gross_cy")


def subsector_yoy(ledger: DataFrame, flt: LedgerFilter) -> DataFrame:
    """Gross of both periods per raw sector, subsector and industry code."""
    rows = ledger.where(flt.either() & gross2())
    for key in HIERARCHY:
        rows = rows.where(F.col(key).isNotNull())
    return rows.groupBy(*HIERARCHY).agg(
        sum_in_period(flt.in_py()).alias("gross_py"),
        sum_in_period(flt.in_cy()).alias("gross_cy"),
    )


def _of_sector(detail: DataFrame, sector: str | None) -> DataFrame:
    return detail.where(F.col("sector") == sector) if sector is not None else detail


def _rollup(
    ledger: DataFrame, flt: LedgerFilter, sector: str | None, key: str
) -> DataFrame:
    cy, py = F.col("gross_cy"), F.col("gross_py")
    return (
        _of_sector(subsector_yoy(ledger, flt), sector)
        .groupBy(key)
        .agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES])
        .withColumn("difference", cy - py)
        .withColumn("growth_pct", growth_pct(cy, py))
    )


def subsector_rollup(
    ledger: DataFrame, flt: LedgerFilter, sector: str | None = None
) -> DataFrame:
    """Gross per subsector of one sector, or of all, with difference and growth."""
    return _rollup(ledger, flt, sector, "subsector")


def klu_rollup(ledger: DataFrame, flt: LedgerFilter, sector: str | None = None) -> DataFrame:
    """Gross per industry code of one sector, or of all, with difference and growth."""
    return _rollup(ledger, flt, sector, "klu")


def _sector_tax(ledger: DataFrame, flt: LedgerFilter) -> DataFrame:
    return (
        ledger.where(flt.cy()).groupBy("sector", "tax_type").agg(F.sum("nominal").alias("value"))
    )


def sector_tax_flow_nodes(ledger: DataFrame, flt: LedgerFilter) -> DataFrame:
    """Numbered nodes of the flow from sectors to tax types."""
    return flow_nodes(_sector_tax(ledger, flt), "sector", "tax_type", ["value"])


def sector_tax_flow_links(ledger: DataFrame, flt: LedgerFilter) -> DataFrame:
    """Net per sector and tax type as links between numbered nodes."""
    return flow_links(_sector_tax(ledger, flt), "sector", "tax_type", ["value"])


def subsector_flow_nodes(
    ledger: DataFrame, flt: LedgerFilter, sector: str | None = None
) -> DataFrame:
    """Numbered nodes of the flow from sectors to subsectors."""
    detail = _of_sector(subsector_yoy(ledger, flt), sector)
    return flow_nodes(detail, "sector", "subsector", MEASURES)


def subsector_flow_links(
    ledger: DataFrame, flt: LedgerFilter, sector: str | None = None, per_klu: bool = False
) -> DataFrame:
    """Gross of both periods from sector to subsector; the empty sector is left out.

    One link per pair, with 0 for a period without rows, or with ``per_klu`` one per
    industry code.
    """
    detail = _of_sector(subsector_yoy(ledger, flt), sector)
    links = flow_links(detail, "sector", "subsector", MEASURES, without_source="")
    if per_klu:
        return links
    ends = ("sector", "subsector", "source_node", "target_node")
    return links.groupBy(*ends).agg(
        *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES]
    )
