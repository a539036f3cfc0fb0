"""Reports from stored grains and from a page's one aggregate."""

import datetime as dt
import random
import re

import pytest

import __spark_entry__ as registry
from ledgerlens import LedgerFilter
from ledgerlens.plans import page, payer, sector, tax_type, trend
from ledgerlens.session import scratch_path
from ledgerlens.sources import LedgerLattice, star
from tests.check import executed_plan
from tests.conftest import SF_DIR

COLUMNS = ("paid_on", "nominal", "kind", "pay_year", "pay_month", *registry.CATEGORIES, "npwp", "payer")


@pytest.fixture(scope="module")
def ledger(spark):
    return star.star_ledger(spark, SF_DIR, COLUMNS)


@pytest.fixture(scope="module")
def lattice(spark, ledger):
    return LedgerLattice.store(ledger, scratch_path(spark, "lattice"), registry.GRAINS)


def rows(df):
    return sorted(map(str, df.collect()))


def test_the_smallest_covering_grain_serves(lattice):
    assert lattice.route(["pay_month"]).name == "months"
    assert lattice.route(["sector", "pay_month"]).name == "codes"
    assert lattice.route(["payer"]).name == "payers"
    chosen = LedgerFilter(dt.date(2000, 1, 1), dt.date(2000, 6, 30), offices=("NATION_1",))
    assert lattice.route(["pay_month"], chosen).name == "codes"
    counts = {g.name: g.rows for g in lattice.grains}
    assert counts["months"] < counts["codes"] < counts["payers"]


def test_a_column_that_no_grain_has_is_refused(lattice):
    with pytest.raises(ValueError, match="officer"):
        lattice.route(["officer"])


def test_reopened_lattice_routes_alike(spark, lattice):
    again = LedgerLattice.open(spark, lattice.root)
    assert sorted(again.grains, key=str) == sorted(lattice.grains, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_routed_reports_equal_those_on_the_star(spark, ledger, lattice, seed):
    rng = random.Random(seed)
    start = dt.date(1999, rng.randint(1, 12), rng.randint(1, 28))
    flt = LedgerFilter(
        start,
        start + dt.timedelta(days=rng.randint(20, 500)),
        offices=rng.sample([f"NATION_{i}" for i in range(25)], rng.choice([0, 8])),
        tax_types=rng.sample(["STANDARD", "ECONOMY", "PROMO", "SMALL"], rng.choice([0, 2])),
    )
    labels = star.star_sector_labels(spark)
    cases = {
        "months": (trend.monthly_growth, ("pay_year", "pay_month"), ()),
        "codes": (sector.sector_yoy, ("sector",), (labels,)),
        "types": (tax_type.tax_type_yoy, ("tax_type",), ()),
        "payers": (payer.payer_totals, ("npwp", "payer"), ()),
    }
    for build, columns, sides in cases.values():
        grain = lattice.route(columns, flt)
        served = build(lattice.ledger(columns, flt), *sides, flt=flt)
        assert rows(served) == rows(build(ledger, *sides, flt=flt))
        plan = executed_plan(served)
        files = served.inputFiles()
        assert files and all(f"grain={grain.name}/" in f for f in files)
        assert re.search(r"PartitionFilters: \[.*paid_ym", plan)


def test_coarse_grains_are_summed_from_finer_ones(spark, ledger):
    """Only the finest grain reads the ledger: without its files the others can't be missed."""
    made = LedgerLattice.store(
        ledger, scratch_path(spark, "grains"), {"a": ("sector", "payer"), "b": ("sector",), "c": ()}
    )
    totals = {g.name: made.read(g.name).agg({"nominal": "sum"}).first()[0] for g in made.grains}
    assert len(set(totals.values())) == 1
    assert [g.name for g in made.grains] == ["a", "b", "c"]


def test_values_come_from_the_smallest_grain(ledger, lattice):
    got = {tuple(r) for r in lattice.values(["sector", "payer"]).collect()}
    want = {("sector", r[0]) for r in ledger.select("sector").distinct().collect() if r[0]}
    want |= {("payer", r[0]) for r in ledger.select("payer").distinct().collect() if r[0]}
    assert got == want
    assert all("grain=codes/" in f for f in lattice.values(["sector"]).inputFiles())


def test_a_page_scans_the_ledger_once(spark, ledger, tmp_path):
    path = str(tmp_path / "ledger")
    ledger.write.parquet(path)
    targets, labels = star.star_targets(spark, SF_DIR), star.star_sector_labels(spark)
    flt = registry.CHOSEN
    reports = page.headline_page(spark.read.parquet(path), targets, labels, flt)
    # With the payments gone every report still stands: none reads them again.
    for part in (tmp_path / "ledger").iterdir():
        part.unlink()
    assert set(reports) == set(page.HEADLINE)
    for name, report in reports.items():
        build, _, sides = page._REPORTS[name]
        taken = [{"targets": targets, "labels": labels}[s] for s in sides]
        assert rows(report) == rows(build(ledger, *taken, flt=flt)), name


def test_a_page_of_an_empty_ledger(spark, make_ledger):
    targets, labels = star.star_targets(spark, SF_DIR), star.star_sector_labels(spark)
    none = make_ledger({}).limit(0)
    for name, report in page.headline_page(none, targets, labels, registry.HALF_YEAR).items():
        build, _, sides = page._REPORTS[name]
        taken = [{"targets": targets, "labels": labels}[s] for s in sides]
        assert rows(report) == rows(build(none, *taken, flt=registry.HALF_YEAR)), name
