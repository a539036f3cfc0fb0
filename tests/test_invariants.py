"""Relations that must hold between and within reports."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlens import LedgerFilter
from ledgerlens.plans import kpi, office, payer, sector, subsector, tax_type, trend
from ledgerlens.sources import compact_ledger, star_ledger
from ledgerlens.sources.star import star_sector_labels, star_targets
from tests.conftest import SF_DIR


@pytest.fixture(scope="module")
def ledger(spark):
    return star_ledger(spark, SF_DIR).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return star_sector_labels(spark)


def total(df, column):
    return df.agg(F.sum(column)).first()[0]


def test_bands_add_up(ledger, flt):
    for report in (payer.payer_bands_gross(ledger, flt), payer.payer_bands_net(ledger, flt)):
        rows = report.collect()
        bands = [r for r in rows if r.row_kind == "band"]
        whole = next(r for r in rows if r.row_kind == "total")
        assert sum(r.gross for r in bands) == whole.gross
        assert sum(r.n for r in bands) == whole.n
        assert sum(r.gross for r in rows if r.row_kind == "payer") == bands[0].gross


def test_flow_links_carry_the_whole_net(ledger, flt):
    links = subsector.sector_tax_flow_links(ledger, flt)
    net = next(r.net for r in kpi.kpi_totals(ledger, flt).collect() if r.period == "cy")
    assert total(links, "value") == net
    assert links.where("source_node is null or target_node is null").count() == 0


def test_shares_add_up_to_hundred(ledger, flt):
    assert total(tax_type.deposit_code_contribution(ledger, flt), "share_pct") == pytest.approx(100)
    assert total(sector.klu_contribution(ledger, flt), "share_pct") == pytest.approx(100)
    officers = office.officer_contribution(ledger, 2000)
    assert total(officers, "region_share_pct") == pytest.approx(100)
    for key in ("section", "office"):
        for row in officers.groupBy(key).agg(F.sum(f"{key}_share_pct").alias("s")).collect():
            assert row.s == pytest.approx(100)


def test_prior_window_is_the_current_window_a_year_earlier(ledger, labels, flt):
    earlier = LedgerFilter(dt.date(1999, 1, 1), dt.date(1999, 6, 30))
    now = {r.sector: (r.gross_py, r.net_py) for r in sector.sector_yoy(ledger, labels, flt).collect()}
    then = {
        r.sector: (r.gross_cy, r.net_cy)
        for r in sector.sector_yoy(ledger, labels, earlier).collect()
    }
    assert now == then


def test_coarser_reports_sum_finer_ones(ledger, labels, flt):
    by_sector = {r.sector: r.net_cy for r in sector.sector_yoy(ledger, labels, flt).collect()}
    for finer in (
        sector.sector_payer_yoy(ledger, labels, flt),
        sector.sector_month_yoy(ledger, labels, flt),
    ):
        sums = finer.groupBy("sector").agg(F.sum("net_cy").alias("s")).collect()
        assert {r.sector: r.s for r in sums} == by_sector
    by_tax = {r.tax_type: r.net_cy for r in tax_type.tax_type_yoy(ledger, flt).collect()}
    sums = (
        tax_type.tax_type_payer_yoy(ledger, flt)
        .groupBy("tax_type")
        .agg(F.sum("net_cy").alias("s"))
        .collect()
    )
    assert {r.tax_type: r.s for r in sums} == by_tax


@pytest.mark.parametrize("parts", [1, 7])
def test_results_do_not_depend_on_partitioning(ledger, labels, flt, parts):
    spread = ledger.repartition(parts, "nominal")
    for report in (
        lambda x: payer.payer_bands_net(x, flt),
        lambda x: payer.payer_movers(x, flt),
        lambda x: office.top10_payers_per_office(x, flt),
        lambda x: subsector.subsector_flow_links(x, flt),
        lambda x: sector.sector_surplus_shortfall(x, labels, flt),
    ):
        assert report(spread).exceptAll(report(ledger)).count() == 0


def test_ordered_variants_hold_the_same_rows(ledger, labels, flt):
    for report in (
        lambda o: payer.payer_totals(ledger, flt, ordered=o),
        lambda o: sector.sector_payer_yoy(ledger, labels, flt, ordered=o),
        lambda o: tax_type.tax_type_payer_yoy(ledger, flt, ordered=o),
    ):
        assert report(True).exceptAll(report(False)).count() == 0
    nets = [r.net for r in payer.payer_totals(ledger, flt, ordered=True).collect()]
    assert nets == sorted(nets, reverse=True)


def test_compact_ledger_gives_the_same_reports(spark, ledger, labels, flt):
    targets = star_targets(spark, SF_DIR)
    compact = compact_ledger(
        ledger,
        ["paid_on", "pay_year", "pay_month", "kind", "office", "sector", "tax_type", "segment"],
    ).cache()
    assert compact.count() < ledger.count()
    chosen = LedgerFilter(flt.start, flt.end, segments=["1-URGENT"], sectors=["BUILDING"])
    for report in (
        lambda x: kpi.kpi_cards(x, targets, flt),
        lambda x: kpi.kpi_totals(x, chosen),
        lambda x: kpi.receipt_kind_yoy(x, flt),
        lambda x: trend.monthly_trend(x, targets, chosen),
        lambda x: trend.monthly_growth(x, flt),
        lambda x: sector.sector_month_yoy(x, labels, flt),
        lambda x: tax_type.tax_type_yoy(x, chosen),
        lambda x: office.office_attainment(x, targets, flt),
        lambda x: subsector.sector_tax_flow_links(x, flt),
    ):
        full, small = report(ledger), report(compact)
        assert full.columns == small.columns
        assert full.exceptAll(small).count() == small.exceptAll(full).count() == 0
