"""Shape of the physical plans: one ledger scan, no Python, no single-task work on rows."""

import functools
import re

import pytest

import __spark_entry__ as registry
from tests.check import executed_plan
from tests.conftest import SF_DIR

QUERIES = registry.ledger_queries()
# These read what a query has written: a finished report or the stored ledger.
WRITTEN = {"export_report", "export_report_csv", "filter_options_stored"}
STORED = {"ledger_table", "ledger_table_compact", "ledger_table_refreshed"} | {n for n in QUERIES if n.startswith("routed_")}
PAGE = {n for n in QUERIES if n.startswith("page_")}
REPORTS = sorted(QUERIES)
# Without the variants that differ in their filter or display only.
VARIANTS = ("_chosen", "_all_dates", "_labels", "_of_sector", "_as_refund", "_by_growth", "_daily")
SHAPES = [n for n in REPORTS if not n.endswith(VARIANTS)]


@pytest.fixture(scope="module")
def run_shuffled(spark):
    """Plan of a query when no side is small enough to broadcast, as at full scale."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, "-1")

    @functools.cache
    def plan(name):
        df = QUERIES[name](spark, SF_DIR)
        df.collect()
        return executed_plan(df)

    yield plan
    for key in keys:
        spark.conf.unset(key)


def fact_scans(plan):
    return len(re.findall(r"FileScan parquet .*?lineitem\.parquet", plan))


def check_operators(plan):
    for operator in ("Python", "Pandas", "CartesianProduct", "NestedLoopJoin"):
        assert operator not in plan


@pytest.mark.parametrize("name", REPORTS)
def test_ledger_is_scanned_once(run, name):
    plan = run(name)[2]
    if name == "top10_payers_per_office_bucketed":
        assert plan.count("SelectedBucketsCount") + plan.count("Bucketed: true") >= 1
        return
    without = {"target_totals", "plan_vs_actual"} | WRITTEN | STORED | PAGE
    assert fact_scans(plan) == (0 if name in without else 1)
    check_operators(plan)


@pytest.mark.parametrize("name", sorted(STORED))
def test_stored_ledger_is_scanned_once_and_pruned(run, name):
    (scan,) = re.findall(r"FileScan parquet .*", run(name)[2])
    assert re.search(r"PartitionFilters: \[.*paid_ym", scan)


@pytest.mark.parametrize("name", sorted(STORED))
def test_report_on_a_stored_ledger_writes_nothing_again(spark, run, name):
    run(name)
    before = dict(registry._STORED)
    assert QUERIES[name](spark, SF_DIR).inputFiles()
    assert registry._STORED == before


LISTED = [n for n in REPORTS if n.endswith("_of_listed") and n != "payer_totals_of_listed"]


@pytest.mark.parametrize("name", LISTED)
def test_a_long_list_is_one_join_and_no_literal(run_shuffled, name):
    plan = run_shuffled(name)
    assert len(re.findall(r"Join.*(?:LeftSemi|ExistenceJoin)", plan)) == 1
    assert fact_scans(plan) == 1


def test_bucketed_payments_are_not_shuffled_by_order(spark, run):
    """Below the first join there is an exchange on the orders' side alone, broadcasts off."""
    run("top10_payers_per_office_bucketed")
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, "-1")
    try:
        df = QUERIES["top10_payers_per_office_bucketed"](spark, SF_DIR)
        rows = {tuple(r) for r in df.collect()}
        plan = executed_plan(df)
    finally:
        for key in keys:
            spark.conf.unset(key)
    assert "Bucketed: true" in plan
    exchanges = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
    assert "l_orderkey" not in exchanges
    plain = QUERIES["top10_payers_per_office"](spark, SF_DIR).collect()
    assert rows == {tuple(r) for r in plain}


def test_stored_options_read_no_payments(run):
    scans = re.findall(r"FileScan parquet .*", run("filter_options_stored")[2])
    assert len(scans) == 1 and scans[0].startswith("FileScan parquet [dimension")


@pytest.mark.parametrize("name", sorted(PAGE))
def test_reports_of_a_page_read_its_aggregate_alone(run, name):
    scans = re.findall(r"FileScan parquet .*", run(name)[2])
    assert sum("/page-" in scan for scan in scans) == 1
    assert not any("lineitem" in scan or "orders" in scan for scan in scans)


@pytest.mark.parametrize("name", REPORTS)
def test_single_partition_only_above_an_aggregate(run, name):
    """Whatever moves into one task has been aggregated or cut to a top list before."""
    lines = run(name)[2].splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line and "ReusedExchange" not in line:
            below = lines[i + 1 : i + 8]
            assert any(re.search(r"HashAggregate|TakeOrdered|Limit", text) for text in below)


@pytest.mark.parametrize("name", [n for n in REPORTS if not n.endswith("all_dates")])
def test_date_windows_reach_the_scan(run, name):
    scan = next((x for x in run(name)[2].splitlines() if "lineitem.parquet" in x), None)
    if scan is None or name == "filter_options":
        return
    assert re.search(r"PushedFilters: \[.*l_shipdate", scan)
    assert not re.search(r"ReadSchema:.*(l_tax|l_discount|l_suppkey|l_quantity)", scan)


def test_payers_are_shuffled_once_for_the_sector_report(run):
    assert len(re.findall(r"\+- Exchange", run("sector_payer_yoy")[2])) == 1


@pytest.mark.parametrize("name", SHAPES)
def test_ledger_is_scanned_once_without_broadcasts(run_shuffled, name):
    plan = run_shuffled(name)
    assert fact_scans(plan) <= 1
    check_operators(plan)


def test_rank_limit_runs_before_the_office_shuffle(run_shuffled):
    plan = run_shuffled("top10_payers_per_office")
    final = plan.index("row_number(), 10, Final")
    exchange = plan.index("Exchange hashpartitioning(office")
    partial = plan.index("row_number(), 10, Partial")
    assert final < exchange < partial
