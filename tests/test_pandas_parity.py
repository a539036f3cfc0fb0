"""Random ledgers through pandas pivots, whose treatment of missing values the reports follow."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from ledgerlens.dims import SECTOR_LABELS_COLUMNS, local_table
from ledgerlens.plans import payer, sector, subsector, tax_type

LABELS = {"X": "x", "Y": "y", "": "", "X2": "x"}
WINDOWS = {
    "cy": (dt.date(2000, 1, 1), dt.date(2000, 6, 30)),
    "py": (dt.date(1999, 1, 1), dt.date(1999, 6, 30)),
}


def random_rows(seed, size=300):
    rng = np.random.default_rng(seed)

    def pick(*values):
        return values[rng.integers(len(values))]

    return [
        {
            "paid_on": dt.date(int(rng.integers(1998, 2002)), int(rng.integers(1, 13)), 15),
            "nominal": int(rng.integers(-50, 100)),
            "kind": pick("MPN", "SPM", "PBK KIRIM", "PBK TERIMA", "SPMKP", "SPMKP"),
            "sector": pick("X", "X2", "Y", "", "UNKNOWN", None),
            "subsector": pick("a", "b", None),
            "klu": pick("k1", "k2", "k3"),
            "tax_type": pick("T1", "T2", None),
            "payer_kind": pick("OP", "BADAN", None),
            "npwp": pick("N1", "N2", "N3", "N4", None),
            "payer": pick("P1", "P2", None),
        }
        for _ in range(size)
    ]


def stacked(rows):
    """Rows of both windows with their period, gross and net amounts."""
    frame = pd.DataFrame(rows)
    parts = []
    for period, (start, end) in WINDOWS.items():
        part = frame[(frame["paid_on"] >= start) & (frame["paid_on"] <= end)].copy()
        part["period"] = period
        parts.append(part)
    both = pd.concat(parts, ignore_index=True)
    both["net"] = both["nominal"].astype(float)
    both["gross"] = both["net"].where(both["kind"].isin(["MPN", "SPM"]))
    return both


def pivoted(both, keys, values):
    table = both.pivot_table(index=keys, columns="period", values=values, aggfunc="sum")
    table.columns = ["_".join(c) for c in table.columns]
    return table.reset_index()


def as_set(rows):
    def cell(value):
        missing = value is None or (isinstance(value, float) and math.isnan(value))
        return None if missing else round(value, 6) if isinstance(value, (int, float)) else value

    return sorted((tuple(cell(v) for v in row) for row in rows), key=repr)


def same(report, expected, columns):
    have = as_set(tuple(r[c] for c in columns) for r in report.collect())
    assert have == as_set(expected[columns].itertuples(index=False, name=None))


@pytest.fixture(params=[1, 2, 3])
def data(request, make_ledger):
    rows = random_rows(request.param)
    return make_ledger(*rows), stacked(rows)


MEASURES = ["gross_cy", "gross_py", "net_cy", "net_py"]


def test_sector_reports(data, spark, flt):
    ledger, both = data
    labels = local_table(spark, list(LABELS.items()), SECTOR_LABELS_COLUMNS)
    both["sector"] = both["sector"].map(LABELS)
    want = pivoted(both, ["sector"], ["gross", "net"])
    want["rise_gross"] = want["gross_cy"] - want["gross_py"]
    want["growth_gross_pct"] = (want["rise_gross"] / want["gross_py"] * 100).replace(
        [np.inf, -np.inf], np.nan
    )
    same(
        sector.sector_yoy(ledger, labels, flt),
        want,
        ["sector", *MEASURES, "rise_gross", "growth_gross_pct"],
    )
    want = pivoted(both, ["payer", "sector"], ["gross", "net"])
    same(sector.sector_payer_yoy(ledger, labels, flt), want, ["payer", "sector", *MEASURES])
    both["pay_month"] = [d.month for d in both["paid_on"]]
    want = pivoted(both, ["sector", "pay_month"], ["gross", "net"])
    same(sector.sector_month_yoy(ledger, labels, flt), want, ["sector", "pay_month", *MEASURES])


def test_tax_type_reports(data, flt):
    ledger, both = data
    for report, keys in (
        (tax_type.tax_type_yoy, ["tax_type"]),
        (tax_type.tax_type_payer_yoy, ["payer", "tax_type", "payer_kind"]),
    ):
        want = pivoted(both, keys, ["gross", "net"])
        want["share_cy_pct"] = (want["gross_cy"] / want["gross_cy"].sum() * 100).round(2)
        same(report(ledger, flt), want, [*keys, *MEASURES, "share_cy_pct"])


def test_subsector_reports(data, flt):
    ledger, both = data
    receipts = both[both["kind"].isin(["MPN", "SPM"])]
    keys = ["sector", "subsector", "klu"]
    detail = pivoted(receipts, keys, ["gross"])
    same(subsector.subsector_yoy(ledger, flt), detail, [*keys, "gross_cy", "gross_py"])
    rollup = detail.groupby("subsector")[["gross_cy", "gross_py"]].sum().reset_index()
    same(subsector.subsector_rollup(ledger, flt), rollup, ["subsector", "gross_cy", "gross_py"])


def test_payer_reports(data, flt):
    ledger, both = data
    keys = ["npwp", "payer"]
    now = both[both["period"] == "cy"]
    want = now.groupby(keys)[["net", "gross"]].sum().reset_index()
    same(payer.payer_totals(ledger, flt), want, [*keys, "net", "gross"])
    moves = pivoted(both[both["kind"].isin(["MPN", "SPM"])], keys, ["gross"])
    moves["difference"] = moves["gross_cy"] - moves["gross_py"]
    top = payer.payer_movers(ledger, flt).where("side = 'top'")
    assert len(moves) <= 10
    same(top, moves, [*keys, "gross_cy", "gross_py", "difference"])


def test_average_ranks(data, spark, flt):
    ledger, both = data
    labels = local_table(spark, list(LABELS.items()), SECTOR_LABELS_COLUMNS)
    both["sector"] = both["sector"].map(LABELS)
    want = pivoted(both, ["sector"], ["gross", "net"])
    want["rank"] = want["gross_py"].rank(ascending=False)
    report = sector.sector_surplus_shortfall(ledger, labels, flt, rank_by="gross_py")
    same(report.where("side = 'all'"), want, ["sector", "rank"])
