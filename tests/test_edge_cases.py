"""Hand-made ledgers for the rules a report has to follow."""

import datetime as dt

import pytest

from ledgerlens import LedgerFilter
from ledgerlens.dims import SECTOR_LABELS_COLUMNS, TARGETS_COLUMNS, local_table
from ledgerlens.plans import extras, kpi, office, payer, sector, subsector, tax_type, trend

D = dt.date
CY, PY = D(2000, 3, 1), D(1999, 3, 1)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [("X", "x"), ("Y", "y"), ("", ""), ("X2", "x")]
    return local_table(spark, rows, SECTOR_LABELS_COLUMNS)


@pytest.fixture(scope="module")
def targets(spark):
    return local_table(spark, [("A", 1000, 800), ("B", 500, 200)], TARGETS_COLUMNS)


def rows_by(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


# -- overlapping windows --------------------------------------------------------------


def test_overlapping_windows_count_a_row_once_per_period(make_ledger, labels):
    flt = LedgerFilter(D(1999, 1, 1), D(2000, 6, 30))
    ledger = make_ledger(
        {"paid_on": D(1999, 3, 1), "nominal": 10},
        {"paid_on": D(2000, 3, 1), "nominal": 5},
        {"paid_on": D(1998, 3, 1), "nominal": 2},
    )
    row = sector.sector_yoy(ledger, labels, flt).first()
    assert (row.net_cy, row.net_py) == (15, 12)
    months = rows_by(trend.monthly_trend(ledger, _no_targets(ledger), flt), "pay_year", "pay_month")
    assert {k: v["net"] for k, v in months.items()} == {(1998, 3): 2, (1999, 3): 10, (2000, 3): 5}


def _no_targets(df):
    return local_table(df.sparkSession, [("A", 100, 50)], TARGETS_COLUMNS)


# -- missing against zero -------------------------------------------------------------


def test_refund_only_group_has_zero_gross_and_absent_year_none(make_ledger, labels, flt):
    ledger = make_ledger({"kind": "SPMKP", "nominal": -7, "paid_on": CY})
    row = sector.sector_yoy(ledger, labels, flt).first()
    assert (row.gross_cy, row.net_cy, row.gross_py, row.net_py) == (0, -7, None, None)
    assert row.rise_gross is None and row.growth_gross_pct is None
    assert sector.sector_totals(ledger, labels, flt).first().gross is None
    tax = tax_type.tax_type_yoy(ledger, flt).first()
    assert (tax.gross_cy, tax.gross_py) == (0, None)


def test_sparkline_and_rollups_fill_absent_periods(make_ledger, labels, flt):
    ledger = make_ledger({"nominal": 4, "paid_on": CY})
    spark_row = sector.sector_sparkline(ledger, labels, flt).first()
    assert (spark_row.gross_cy, spark_row.gross_py, spark_row.net_py) == (4, 0, 0)
    rollup = subsector.subsector_rollup(ledger, flt).first()
    assert (rollup.gross_cy, rollup.gross_py, rollup.difference, rollup.growth_pct) == (4, 0, 4, None)


def test_kpi_keeps_missing_sums_but_cards_show_zero(make_ledger, targets, flt):
    ledger = make_ledger({"nominal": 4, "paid_on": CY})
    totals = rows_by(kpi.kpi_totals(ledger, flt), "period")
    assert totals[("py",)] == {"period": "py", "gross": None, "net": None, "share": None}
    card = kpi.kpi_cards(ledger, targets, flt).first()
    assert (card.net_py, card.gross_growth_pct, card.share_pct) == (0, 100.0, 100.0)


def test_share_denominator_ignores_value_lists(make_ledger, flt):
    ledger = make_ledger(
        {"office": "A", "nominal": 30, "paid_on": CY}, {"office": "B", "nominal": 70, "paid_on": CY}
    )
    chosen = LedgerFilter(flt.start, flt.end, offices=["A"])
    totals = rows_by(kpi.kpi_totals(ledger, chosen), "period")
    assert totals[("cy",)]["net"] == 30
    assert totals[("cy",)]["share"] == pytest.approx(0.3)


# -- missing keys ---------------------------------------------------------------------


def test_unlabelled_sectors(make_ledger, labels, flt):
    ledger = make_ledger(
        {"sector": None, "nominal": 1, "paid_on": CY},
        {"sector": "UNKNOWN", "nominal": 2, "paid_on": CY},
        {"sector": "", "nominal": 4, "paid_on": CY},
        {"sector": "X", "nominal": 8, "paid_on": CY},
        {"sector": "X2", "nominal": 16, "paid_on": CY},
    )
    yoy = {r.sector: r.net_cy for r in sector.sector_yoy(ledger, labels, flt).collect()}
    assert yoy == {"": 4, "x": 24}
    totals = {(r.sector, r.label): r.net for r in sector.sector_totals(ledger, labels, flt).collect()}
    assert totals == {(None, None): 1, ("UNKNOWN", None): 2, ("", ""): 4, ("X", "x"): 8, ("X2", "x"): 16}
    pairs = {r.sector: r.net_cy for r in sector.sector_payer_yoy(ledger, labels, flt).collect()}
    assert pairs == {"": 4, "x": 24}


def test_missing_keys_leave_pivoted_reports(make_ledger, labels, flt):
    ledger = make_ledger(
        {"payer": None, "paid_on": CY},
        {"npwp": None, "paid_on": CY},
        {"tax_type": None, "paid_on": CY},
        {"klu": None, "paid_on": CY},
        {"payer_kind": None, "paid_on": CY},
        {"paid_on": CY},
    )
    assert payer.payer_totals(ledger, flt).agg({"net": "sum"}).first()[0] == 4
    assert payer.payer_movers(ledger, flt).where("side = 'top'").first().gross_cy == 4
    assert tax_type.tax_type_yoy(ledger, flt).first().net_cy == 5
    assert tax_type.tax_type_payer_yoy(ledger, flt).agg({"net_cy": "sum"}).first()[0] == 3
    assert subsector.subsector_yoy(ledger, flt).agg({"gross_cy": "sum"}).first()[0] == 5
    assert sector.sector_payer_yoy(ledger, labels, flt).first().net_cy == 5
    bands = payer.payer_bands_gross(ledger, flt)
    assert bands.where("row_kind = 'total'").first().n == 3


def test_filter_options_skip_missing(make_ledger):
    ledger = make_ledger(
        {"segment": "", "payer": "", "sector": "", "office": "A"},
        {"segment": None, "payer": None, "sector": None, "tax_type": None},
        {"segment": "BIG", "payer": "P"},
    )
    have = {(r.dimension, r.value) for r in kpi.filter_options(ledger).collect()}
    assert have == {
        ("office", "A"), ("tax_type", "T1"), ("sector", ""), ("sector", "X"),
        ("segment", "BIG"), ("payer", "P"),
    }


# -- monthly growth -------------------------------------------------------------------


def test_monthly_growth_by_actual_month(make_ledger, flt):
    ledger = make_ledger(
        {"paid_on": D(2000, 2, 1), "nominal": 30},
        {"paid_on": D(1999, 2, 1), "nominal": 20},
        {"paid_on": D(2000, 4, 1), "nominal": 9},
        {"paid_on": D(2000, 5, 1), "nominal": -6, "kind": "SPMKP"},
        {"paid_on": D(1999, 5, 1), "nominal": -4, "kind": "SPMKP"},
    )
    rows = {r.growth: r.asDict() for r in trend.monthly_growth(ledger, flt).collect()}
    assert list(rows["net"])[1:3] == ["January", "February"]
    assert (rows["gross"]["February"], rows["net"]["February"]) == (50.0, 50.0)
    assert (rows["refund"]["February"], rows["refund"]["May"]) == (0.0, 50.0)
    assert (rows["gross"]["May"], rows["net"]["May"]) == (0.0, 50.0)
    assert rows["net"]["April"] == 0.0
    same = trend.monthly_growth(ledger, flt, refund_kinds=("MPN", "SPM"))
    assert {r.growth: r.February for r in same.collect()}["refund"] == 50.0
    text = trend.monthly_growth(ledger, flt, labels=True).where("growth = 'net'").first()
    assert (text.February, text.December) == ("50.00%", "0.00%")


def test_monthly_growth_without_rows(make_ledger, flt):
    ledger = make_ledger({"paid_on": D(1990, 1, 1)})
    rows = trend.monthly_growth(ledger, flt).collect()
    assert len(rows) == 3 and all(v == 0.0 for r in rows for v in r[1:])


# -- trend ----------------------------------------------------------------------------


def test_trend_runs_within_a_year(make_ledger, targets, flt):
    ledger = make_ledger(
        {"paid_on": D(2000, 1, 5), "nominal": 150},
        {"paid_on": D(2000, 3, 5), "nominal": 300},
        {"paid_on": D(1999, 1, 5), "nominal": 100},
    )
    rows = rows_by(trend.monthly_trend(ledger, targets, flt), "pay_year", "pay_month")
    assert rows[(2000, 3)]["cumulative"] == 450
    assert rows[(2000, 3)]["cumulative_pct"] == pytest.approx(30.0)
    assert rows[(1999, 1)]["cumulative_pct"] == pytest.approx(10.0)
    chosen = LedgerFilter(flt.start, flt.end, offices=["A"])
    rows = rows_by(
        trend.monthly_trend(ledger, targets, chosen, target_scope="offices"), "pay_year", "pay_month"
    )
    assert rows[(2000, 1)]["cumulative_pct"] == pytest.approx(15.0)


# -- receipts by kind, deltas ---------------------------------------------------------


def test_receipt_kinds_follow_the_current_window(make_ledger, flt):
    ledger = make_ledger(
        {"kind": "SPMKP", "nominal": -9, "paid_on": CY},
        {"kind": "SPMKP", "nominal": -4, "paid_on": PY},
        {"kind": "SPM", "nominal": 3, "paid_on": PY},
        {"kind": "MPN", "nominal": 5, "paid_on": CY},
    )
    rows = rows_by(kpi.receipt_kind_yoy(ledger, flt), "kind")
    assert set(rows) == {("SPMKP",), ("MPN",)}
    assert rows[("SPMKP",)]["amount_cy"] == 9 and rows[("SPMKP",)]["difference"] == 5
    assert rows[("MPN",)]["amount_py"] is None and rows[("MPN",)]["difference"] is None


def test_period_delta(make_ledger, targets, flt):
    ledger = make_ledger(
        {"nominal": 300, "paid_on": CY},
        {"nominal": -50, "kind": "SPMKP", "paid_on": CY},
        {"nominal": 250, "paid_on": PY},
        {"nominal": -50, "kind": "SPMKP", "paid_on": PY},
    )
    row = kpi.period_delta(ledger, targets, flt).first()
    assert (row.gross_cy, row.net_py, row.difference) == (300, 200, 100)
    assert row.growth_pct == pytest.approx(50.0)
    assert row.target_share_pct == pytest.approx(20.0)
    empty = kpi.period_delta(ledger.where("false"), targets, flt).first()
    assert (empty.difference, empty.growth_pct) == (0, 0.0)


# -- rank bands -----------------------------------------------------------------------


@pytest.mark.parametrize("payers", [0, 5, 10, 100, 500, 501, 620])
def test_bands_partition_the_payers(make_ledger, spark, flt, payers):
    amounts = [(i * 37) % 1000 + 1 for i in range(payers)]
    ledger = make_ledger(
        *[
            {"npwp": f"N{i:04d}", "payer": f"P{i}", "nominal": a, "paid_on": CY}
            for i, a in enumerate(amounts)
        ],
        {"paid_on": D(1980, 1, 1)},
    )
    rows = payer.payer_bands_net(ledger, flt).collect()
    assert [r.row_kind for r in rows] == ["payer"] * min(payers, 10) + ["band"] * 4 + ["total"]
    ordered = sorted(amounts, reverse=True)
    want = [sum(ordered[a:b]) for a, b in ((0, 10), (10, 100), (100, 500), (500, None))]
    bands = [r for r in rows if r.row_kind == "band"]
    assert [r.net for r in bands] == want
    assert [r.n for r in bands] == [
        len(ordered[a:b]) for a, b in ((0, 10), (10, 100), (100, 500), (500, None))
    ]
    total = rows[-1]
    assert (total.net, total.n) == (sum(amounts), payers)
    assert bands[3].payer == f"Penerimaan 501 s.d. {payers} WP Terbesar"
    assert total.share_pct == (100.0 if payers else None)
    top = payer.largest_payers(payer.payer_bands_net(ledger, flt))
    assert top.count() == min(payers, 10)


def test_band_ties_go_by_id(make_ledger, flt):
    ledger = make_ledger(
        *[{"npwp": f"N{i:02d}", "payer": "same", "nominal": 5, "paid_on": CY} for i in range(12)]
    )
    rows = payer.payer_bands_gross(ledger, flt).where("row_kind = 'payer'").collect()
    assert [r.npwp for r in rows] == [f"N{i:02d}" for i in range(10)]


def test_bands_rank_by_net_and_share_by_gross(make_ledger, flt):
    ledger = make_ledger(
        {"npwp": "N1", "payer": "a", "nominal": 100, "paid_on": CY},
        {"npwp": "N1", "payer": "a", "nominal": -90, "kind": "SPMKP", "paid_on": CY},
        {"npwp": "N2", "payer": "b", "nominal": 50, "paid_on": CY},
        {"npwp": "N3", "payer": "c", "nominal": 20, "kind": "PBK TERIMA", "paid_on": CY},
    )
    rows = payer.payer_bands_net(ledger, flt).where("row_kind = 'payer'").collect()
    assert [(r.payer, r.net, r.gross) for r in rows] == [("b", 50, 50), ("c", 20, 0), ("a", 10, 100)]
    assert rows[2].share_pct == pytest.approx(100 / 150 * 100)
    gross4 = payer.payer_bands_gross(ledger, flt).where("row_kind = 'total'").first()
    assert gross4.gross == 170


# -- movers ---------------------------------------------------------------------------


def test_movers_put_incomplete_payers_last(make_ledger, flt):
    ledger = make_ledger(
        {"npwp": "N1", "payer": "up", "nominal": 10, "paid_on": CY},
        {"npwp": "N1", "payer": "up", "nominal": 4, "paid_on": PY},
        {"npwp": "N2", "payer": "down", "nominal": 1, "paid_on": CY},
        {"npwp": "N2", "payer": "down", "nominal": 9, "paid_on": PY},
        {"npwp": "N3", "payer": "new", "nominal": 999, "paid_on": CY},
    )
    rows = payer.payer_movers(ledger, flt).collect()
    sides = {s: [r.payer for r in rows if r.side == s] for s in ("top", "bottom")}
    assert sides == {"top": ["up", "down", "new"], "bottom": ["down", "up", "new"]}
    assert [r.difference for r in rows if r.payer == "new"] == [None, None]


# -- offices --------------------------------------------------------------------------


def test_attainment_divides_growth_by_prior_target(make_ledger, targets, flt):
    ledger = make_ledger(
        {"office": "A", "nominal": 500, "paid_on": CY},
        {"office": "A", "nominal": 100, "paid_on": PY},
        {"office": "C", "nominal": 1, "paid_on": CY},
    )
    rows = office.office_attainment(ledger, targets, flt).collect()
    assert [r.office for r in rows] == ["A"]
    assert rows[0].attainment_pct == pytest.approx(50.0)
    assert rows[0].growth_pct == pytest.approx(50.0)
    mean = office.office_attainment_mean(ledger, targets, flt).first()
    assert mean.mean_attainment_pct == pytest.approx(50.0)


def test_top10_skips_placeholders_and_prior_only_payers(make_ledger, flt):
    ledger = make_ledger(
        {"npwp15": "0000000001", "nominal": 99, "paid_on": CY},
        {"npwp15": None, "nominal": 98, "paid_on": CY},
        {"npwp15": "92", "payer": "old", "nominal": 50, "paid_on": PY},
        {"npwp15": "93", "payer": "zero", "nominal": 5, "paid_on": CY},
        {"npwp15": "93", "payer": "zero", "nominal": 0, "paid_on": PY},
        *[
            {"npwp15": f"8{i:02d}", "payer": f"P{i}", "nominal": 7, "paid_on": CY}
            for i in range(12)
        ],
    )
    rows = office.top10_payers_per_office(ledger, flt).orderBy("rank").collect()
    assert [r.npwp15 for r in rows] == [f"8{i:02d}" for i in range(10)]
    rows = office.top10_payers_per_office(ledger.where("npwp15 >= '9'"), flt).collect()
    assert [(r.payer, r.cy, r.py, r.growth_pct) for r in rows] == [("zero", 5, 0, None)]


def test_cluster_means_ignore_excluded_offices(make_ledger, flt):
    ledger = make_ledger(
        {"office": "007", "npwp15": "91", "nominal": 1000, "paid_on": CY},
        {"office": "001", "npwp15": "92", "nominal": 30, "paid_on": CY},
        {"office": "001", "npwp15": "92", "nominal": 20, "paid_on": PY},
        {"office": "002", "npwp15": "93", "nominal": 10, "paid_on": CY},
    )
    rows = office.top10_payers_cluster(ledger, flt).collect()
    assert {r.office for r in rows} == {"001", "002"}
    assert {(r.mean_cy, r.mean_growth_pct) for r in rows} == {(20.0, 50.0)}


def test_sections_of_one_name_share_a_denominator(make_ledger):
    ledger = make_ledger(
        {"office": "A", "section": "S", "officer": "1", "nominal": 30},
        {"office": "B", "section": "S", "officer": "2", "nominal": 10},
        {"office": "B", "section": "T", "officer": "3", "nominal": 10},
        {"office": "B", "section": "T", "officer": "3", "nominal": -99, "kind": "SPMKP"},
        {"office": "006", "section": "S", "officer": "9", "nominal": 1000},
    )
    rows = rows_by(office.officer_contribution(ledger, 2000), "office", "officer")
    assert set(rows) == {("A", "1"), ("B", "2"), ("B", "3")}
    first = rows[("A", "1")]
    assert first["section_share_pct"] == pytest.approx(75.0)
    assert first["office_share_pct"] == pytest.approx(100.0)
    assert first["region_share_pct"] == pytest.approx(60.0)


def test_target_totals(targets):
    assert kpi.target_totals(targets).first().target_cy == 1500
    chosen = kpi.target_totals(targets, ["B"]).first()
    assert (chosen.target_cy, chosen.target_growth_pct) == (500, 150.0)
    none = kpi.target_totals(targets, ["C"]).first()
    assert (none.target_cy, none.target_growth_pct) == (0, None)


# -- sectors --------------------------------------------------------------------------


def test_ranks_average_ties_and_leave_missing_unranked(make_ledger, spark, flt):
    names = ["a", "b", "c", "d", "KLU ERROR"]
    labels = local_table(spark, [(n, n) for n in names], SECTOR_LABELS_COLUMNS)
    ledger = make_ledger(
        {"sector": "a", "nominal": 10, "paid_on": CY}, {"sector": "a", "nominal": 5, "paid_on": PY},
        {"sector": "b", "nominal": 10, "paid_on": CY}, {"sector": "b", "nominal": 20, "paid_on": PY},
        {"sector": "c", "nominal": 3, "paid_on": CY}, {"sector": "c", "nominal": 1, "paid_on": PY},
        {"sector": "d", "nominal": 8, "paid_on": PY},
        {"sector": "KLU ERROR", "nominal": 50, "paid_on": CY},
        {"sector": "KLU ERROR", "nominal": 1, "paid_on": PY},
    )
    rows = rows_by(sector.sector_surplus_shortfall(ledger, labels, flt), "side", "sector")
    ranks = {k: v["rank"] for k, v in rows.items()}
    assert ranks == {
        ("all", "KLU ERROR"): 1.0, ("all", "a"): 2.5, ("all", "b"): 2.5, ("all", "c"): 4.0,
        ("all", "d"): None, ("surplus", "a"): 1.0, ("surplus", "c"): 2.0, ("shortfall", "b"): 1.0,
    }
    assert rows[("all", "a")]["share_pct"] == pytest.approx(10 / 73 * 100)


def test_other_row_holds_the_rest(make_ledger, spark, flt):
    names = [f"s{i:02d}" for i in range(13)]
    labels = local_table(spark, [(n, n) for n in names], SECTOR_LABELS_COLUMNS)
    ledger = make_ledger(
        *[{"sector": n, "nominal": 100 - i, "paid_on": CY} for i, n in enumerate(names)]
    )
    rows = sector.sectors_with_other(ledger, labels, flt).collect()
    assert len(rows) == 11
    other = next(r for r in rows if r.row_kind == "other")
    assert (other.sector, other.net, other.gross) == ("LAINNYA", 90 + 89 + 88, 90 + 89 + 88)
    few = sector.sectors_with_other(ledger.where("sector = 's00'"), labels, flt).collect()
    assert {(r.sector, r.net) for r in few} == {("s00", 100), ("LAINNYA", 0)}


def test_top10_shares_are_of_all_sectors(make_ledger, spark, flt):
    names = [f"s{i:02d}" for i in range(12)]
    labels = local_table(spark, [(n, n) for n in names], SECTOR_LABELS_COLUMNS)
    ledger = make_ledger(*[{"sector": n, "nominal": 10, "paid_on": CY} for n in names])
    rows = sector.sector_top10(ledger, labels, flt).collect()
    assert [r.sector for r in rows] == names[:10]
    assert sum(r.share_cy_pct for r in rows) == pytest.approx(10 / 12 * 100)


# -- flows ----------------------------------------------------------------------------


def test_flow_nodes_by_side_with_missing_last(make_ledger, flt):
    ledger = make_ledger(
        {"sector": "B", "tax_type": "same", "nominal": 1, "paid_on": CY},
        {"sector": "same", "tax_type": "T", "nominal": 2, "paid_on": CY},
        {"sector": None, "tax_type": None, "nominal": 4, "paid_on": CY},
    )
    nodes = subsector.sector_tax_flow_nodes(ledger, flt).orderBy("node").collect()
    assert [(n.node, n.side, n.label) for n in nodes] == [
        (0, "source", "B"), (1, "source", "same"), (2, "source", None),
        (3, "target", "T"), (4, "target", "same"), (5, "target", None),
    ]
    links = subsector.sector_tax_flow_links(ledger, flt).collect()
    assert {(r.source_node, r.target_node, r.value) for r in links} == {(0, 4, 1), (1, 3, 2), (2, 5, 4)}


def test_subsector_flow_drops_the_empty_sector_but_keeps_its_node(make_ledger, flt):
    ledger = make_ledger(
        {"sector": "", "subsector": "e", "nominal": 1, "paid_on": CY},
        {"sector": "A", "subsector": "a1", "klu": "k1", "nominal": 2, "paid_on": CY},
        {"sector": "A", "subsector": "a1", "klu": "k2", "nominal": 3, "paid_on": PY},
    )
    nodes = {(n.side, n.label) for n in subsector.subsector_flow_nodes(ledger, flt).collect()}
    assert ("source", "") in nodes
    links = subsector.subsector_flow_links(ledger, flt).collect()
    assert [(r.sector, r.subsector, r.gross_cy, r.gross_py) for r in links] == [("A", "a1", 2, 3)]
    assert subsector.subsector_flow_links(ledger, flt, per_klu=True).count() == 2
    assert subsector.subsector_flow_links(ledger, flt, sector="A").first().source_node == 0


# -- side tables ----------------------------------------------------------------------


def test_payers_without_master_record(make_ledger, spark, flt):
    master = spark.createDataFrame([("91", "BADAN")], "npwp15 string, payer_kind string")
    ledger = make_ledger(
        {"npwp15": "91", "nominal": 5, "paid_on": CY},
        {"npwp15": "92", "nominal": 7, "paid_on": CY},
        {"npwp15": None, "nominal": 9, "paid_on": CY},
    )
    rows = {r.payer_kind: r.net for r in extras.payer_kind_receipts(ledger, master, flt).collect()}
    assert rows == {"BADAN": 5, None: 16}


def test_plan_vs_actual(spark):
    plan = spark.createDataFrame(
        [(1, "PLAN", 10**9), (1, "PLAN", 5 * 10**8), (2, "REAL", 7), (None, "REAL", 1)],
        "pay_month int, plan_kind string, amount bigint",
    )
    rows = {(r.pay_month, r.plan_kind): r for r in extras.plan_vs_actual(plan).collect()}
    assert set(rows) == {(1, "PLAN"), (2, "REAL")}
    assert rows[(1, "PLAN")].amount_label == "1.5M"
