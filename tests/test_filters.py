import datetime as dt

import pytest

from ledgerlens import LedgerFilter
from ledgerlens.filters import one_year_earlier, restrict_to
from ledgerlens.plans import kpi

D = dt.date


def test_prior_year_of_leap_day():
    assert one_year_earlier(D(2024, 2, 29)) == D(2023, 2, 28)
    assert one_year_earlier(D(2025, 2, 28)) == D(2024, 2, 28)


def test_leap_window_excludes_first_of_march(make_ledger):
    flt = LedgerFilter(D(2024, 1, 1), D(2024, 2, 29))
    ledger = make_ledger({"paid_on": D(2023, 2, 28)}, {"paid_on": D(2023, 3, 1)})
    assert [r.paid_on for r in ledger.where(flt.py()).collect()] == [D(2023, 2, 28)]


def test_bounds_are_inclusive(make_ledger):
    flt = LedgerFilter(D(2024, 1, 1), D(2024, 1, 31))
    days = [D(2023, 12, 31), D(2024, 1, 1), D(2024, 1, 31), D(2024, 2, 1)]
    ledger = make_ledger(*[{"paid_on": d} for d in days])
    assert {r.paid_on for r in ledger.where(flt.cy()).collect()} == set(days[1:3])


def test_open_bounds(make_ledger):
    ledger = make_ledger({"paid_on": D(1990, 1, 1)}, {"paid_on": D(2030, 1, 1)})
    assert ledger.where(LedgerFilter().cy()).count() == 2
    assert ledger.where(LedgerFilter(start=D(2000, 1, 1)).cy()).count() == 1
    assert ledger.where(LedgerFilter(end=D(2000, 1, 1)).cy()).count() == 1


def test_empty_list_is_no_condition_and_lists_are_anded(make_ledger):
    ledger = make_ledger(
        {"office": "A", "segment": "BIG"},
        {"office": "A", "segment": "SMALL"},
        {"office": "B", "segment": "BIG"},
    )
    assert ledger.where(LedgerFilter().categories()).count() == 3
    chosen = LedgerFilter(offices=["A"], segments=["BIG"])
    assert ledger.where(chosen.categories()).count() == 1


def test_quotes_in_names(make_ledger):
    ledger = make_ledger({"payer": "O'Brien"}, {"payer": "X' OR '1'='1"}, {"payer": "Z"})
    assert ledger.where(LedgerFilter(payers=["O'Brien"]).categories()).count() == 1
    assert ledger.where(LedgerFilter(payers=["X' OR '1'='1"]).categories()).count() == 1


def test_row_in_both_windows_is_scanned_once(make_ledger):
    flt = LedgerFilter(D(2023, 1, 1), D(2024, 6, 30))
    ledger = make_ledger({"paid_on": D(2023, 3, 1)})
    assert ledger.where(flt.either()).count() == 1
    assert ledger.where(flt.in_cy() & flt.in_py()).count() == 1


def test_merged_windows():
    half = LedgerFilter(D(2024, 1, 1), D(2024, 6, 30))
    assert half.windows() == [
        (D(2023, 1, 1), D(2023, 6, 30)),
        (D(2024, 1, 1), D(2024, 6, 30)),
    ]
    year = LedgerFilter(D(2024, 1, 1), D(2024, 12, 31))
    assert year.windows() == [(D(2023, 1, 1), D(2024, 12, 31))]
    assert LedgerFilter().windows() == [(None, None)]


def test_as_of_year_needs_an_end():
    assert LedgerFilter(D(2023, 1, 1), D(2024, 6, 30)).as_of_year == 2024
    with pytest.raises(ValueError):
        LedgerFilter().as_of_year


def test_long_lists_are_a_semi_join(spark, make_ledger):
    ledger = make_ledger(*[{"payer": f"P{i}"} for i in range(5)], {"payer": None})
    listed = spark.range(2, 100_000).selectExpr("concat('P', id) as name")
    twice = listed.union(listed)
    assert {r.payer for r in restrict_to(ledger, "payer", twice).collect()} == {"P2", "P3", "P4"}
    assert restrict_to(ledger, "payer", twice).count() == 3


def test_a_table_of_values_equals_a_list(spark, make_ledger):
    ledger = make_ledger(
        {"payer": "A", "nominal": 5}, {"payer": "B", "nominal": 7}, {"payer": None, "nominal": 9}
    )
    table = spark.createDataFrame([("A",), ("Z",), (None,), ("A",)], "name string")
    window = (dt.date(2000, 1, 1), dt.date(2000, 6, 30))
    listed = LedgerFilter(*window, payers=("A", "Z"))
    for values, want in ((table, listed), (table.limit(0), LedgerFilter(*window, payers=("none",)))):
        got = LedgerFilter(*window, payers=values)
        for name in ("cy", "py", "either"):
            rows = ledger.where(getattr(got, name)()).collect()
            assert rows == ledger.where(getattr(want, name)()).collect()
        assert kpi.kpi_totals(ledger, got).collect() == kpi.kpi_totals(ledger, want).collect()
    assert got.columns() == ["payer"]
