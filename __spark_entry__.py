
from __future__ import annotations

import dataclasses
import datetime as dt
import pathlib
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

import oracle_queries  # noqa: E402
from ledgerlens import LedgerFilter  # noqa: E402
from ledgerlens.filters import restrict_to  # noqa: E402
from ledgerlens.operators import column_filters as cf  # noqa: E402
from ledgerlens.plans import (  # noqa: E402
    extras,
    kpi,
    office,
    page,
    payer,
    sector,
    subsector,
    tax_type,
    trend,
)
from ledgerlens.session import remove_at_exit, scratch_path  # noqa: E402
from ledgerlens.sinks import export_report  # noqa: E402
from ledgerlens.sources import (  # noqa: E402
    LedgerLattice,
    compact_ledger,
    read_ledger,
    read_values,
    replace_months,
    write_ledger,
    write_values,
)
from ledgerlens.sources import star  # noqa: E402

# The corpus operators and their pipeline may be absent; the ledger works without them. What is
# broken inside them is not hidden.
try:
    import corpus_pipeline
    from ledgerlens.llm import oracle as corpus_oracle
    from ledgerlens.llm import queries as corpus_queries
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "ledgerlens.llm"):
        raise
    corpus_pipeline = corpus_oracle = corpus_queries = None

Query = Callable[[SparkSession, str], DataFrame]

HALF_YEAR = LedgerFilter(dt.date(2000, 1, 1), dt.date(2000, 6, 30))
LONG = LedgerFilter(dt.date(1999, 1, 1), dt.date(2000, 6, 30))
ALL_DATES = LedgerFilter()
CHOSEN = LedgerFilter(
    dt.date(2000, 1, 1),
    dt.date(2000, 6, 30),
    offices=("NATION_1", "NATION_2", "NATION_3", "NATION_5", "NATION_6"),
    tax_types=("STANDARD", "ECONOMY", "PROMO"),
    sectors=("BUILDING", "FURNITURE", "MACHINERY"),
    segments=("1-URGENT", "2-HIGH", "5-LOW"),
)
DATE_TEXT = "dd/MM/yyyy"
FACETS = {
    "sector": cf.Membership(("BLDG", "HOME")),
    "gross_cy": cf.NumberRange(1_000_000, 30_000_000),
}
LARGE_OFFICES = ("NATION_7", "NATION_9")
NO_OFFICER_OFFICES = ("NATION_6",)

BASE = ("paid_on", "nominal", "kind")
CATEGORIES = ("office", "tax_type", "sector", "segment")
HIERARCHY = ("sector", "subsector", "klu")


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, so that both engines' last bits do not matter."""
    return df.select(
        *[
            F.round(f"`{f.name}`", 6).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def _report(build, *columns: str, dims: tuple[str, ...] = (), **arguments) -> Query:
    """A query running one report on the ledger columns it needs.

    ``dims`` names the side tables the report takes after the ledger.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ledger = star.star_ledger(spark, sf_dir, dict.fromkeys(BASE + columns))
        sides = {
            "targets": lambda: star.star_targets(spark, sf_dir),
            "labels": lambda: star.star_sector_labels(spark),
            "master": lambda: star.star_payer_master(spark, sf_dir),
        }
        return _rounded(build(ledger, *[sides[name]() for name in dims], **arguments))

    return run


# Ledgers stored by this process: application, star and name to path.
_STORED: dict[tuple[str, str, str], str] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> str:
    """Path of a ledger that is stored once per session and star, and removed with the session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = scratch_path(spark, name)
        write_ledger(build(), path)
        remove_at_exit(spark, path)
        _STORED[key] = path
    return _STORED[key]


def _officers_of_2000(ledger: DataFrame) -> DataFrame:
    return office.officer_contribution(
        ledger, year=2000, excluded_offices=NO_OFFICER_OFFICES
    )


def _target_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(kpi.target_totals(star.star_targets(spark, sf_dir)))


def _plan_vs_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extras.plan_vs_actual(star.star_plan(spark, sf_dir))


def _column_profile(report: Query, date_formats: tuple[str, ...] = ()) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        profile = cf.column_profile(report(spark, sf_dir), date_formats)
        return _rounded(profile.withColumn("choices", F.array_join("choices", "|")))

    return run


def _faceted_profile(report: Query, rules: dict[str, cf.ColumnFilter]) -> Query:
    """The profile of a report's columns while two of them are being filtered."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        profile = cf.faceted_profile(report(spark, sf_dir), rules)
        return _rounded(profile.withColumn("choices", F.array_join("choices", "|")))

    return run


def _inferred_profile(report: Query) -> Query:
    """The profile of a report with dates as text in formats that nobody names."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        texts = report(spark, sf_dir).select(
            F.date_format("paid_on", "dd/MM/yyyy").alias("day_first"),
            F.date_format("paid_on", "d.M.yyyy").alias("dotted"),
            F.date_format("paid_on", "MM/MM/yyyy").alias("either"),
            "sector",
            "gross",
        )
        profile = cf.inferred_profile(texts)
        joined = {c: F.array_join(c, "|") for c in ("choices", "formats")}
        return _rounded(profile.withColumns(joined))

    return run


def _filtered(
    report: Query, rules: dict[str, cf.ColumnFilter], date_formats: tuple[str, ...] = ()
) -> Query:
    return lambda spark, sf_dir: cf.apply_column_filters(
        report(spark, sf_dir), rules, date_formats
    )


def _exported(report: Query, fmt: str, partition_by: tuple[str, ...] = ()) -> Query:
    """A report written to files and read back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result, path = report(spark, sf_dir), scratch_path(spark, "report")
        export_report(result, path, fmt=fmt, partition_by=partition_by)
        remove_at_exit(spark, path)
        reader = spark.read.schema(result.schema)
        if fmt == "csv":
            return reader.csv(path, header=True, escape='"')
        return reader.parquet(path).select(result.columns)

    return run


def _payers_with_debts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payer totals of a long list of payers: the customers with a negative balance."""
    ledger = star.star_ledger(spark, sf_dir, (*BASE, "npwp", "payer"))
    listed = star.read_table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_name")
    return payer.payer_totals(restrict_to(ledger, "payer", listed), HALF_YEAR)


def _of_listed(build, *columns: str, labels: bool = False) -> Query:
    """A report whose filter lists its payers in a table: the customers with a negative balance."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        listed = star.read_table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_name")
        flt = dataclasses.replace(HALF_YEAR, payers=listed)
        ledger = star.star_ledger(spark, sf_dir, dict.fromkeys((*BASE, "payer", *columns)))
        sides = [star.star_sector_labels(spark)] if labels else []
        return _rounded(build(ledger, *sides, flt=flt))

    return run


# Catalog tables of the bucketed stars of this process, by application and star.
_BUCKETED: dict[tuple[str, str], dict[str, str]] = {}


def _bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship on payments and orders stored in buckets by order, once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUCKETED:
        path = scratch_path(spark, "bucketed")
        prefix = f"star_{uuid.uuid4().hex}"
        buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
        _BUCKETED[key] = star.store_bucketed(spark, sf_dir, path, prefix, buckets)
        remove_at_exit(spark, path)
    columns = dict.fromkeys((*BASE, "pay_year", "npwp15", "payer", "office"))
    ledger = star.star_ledger(spark, sf_dir, columns, _BUCKETED[key])
    return _rounded(office.top10_payers_per_office(ledger, HALF_YEAR))


def _largest_payers(ledger: DataFrame) -> DataFrame:
    return payer.largest_payers(payer.payer_bands_net(ledger, HALF_YEAR))


def _full_ledger(spark: SparkSession, sf_dir: str) -> str:
    columns = dict.fromkeys((*BASE, "sector", "payer"))
    return _stored(spark, sf_dir, "ledger", lambda: star.star_ledger(spark, sf_dir, columns))


def _compact_ledger(spark: SparkSession, sf_dir: str) -> str:
    columns = (*BASE, "pay_month", "sector")
    return _stored(
        spark,
        sf_dir,
        "compact",
        lambda: compact_ledger(star.star_ledger(spark, sf_dir, columns), columns),
    )


def _ledger_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report on the stored ledger, reading only the month partitions of its windows."""
    ledger = read_ledger(spark, _full_ledger(spark, sf_dir), HALF_YEAR)
    return _rounded(sector.sector_payer_yoy(ledger, star.star_sector_labels(spark), HALF_YEAR))


def _ledger_table_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report on a stored ledger without payers, as the reports of a whole page would share."""
    ledger = read_ledger(spark, _compact_ledger(spark, sf_dir), HALF_YEAR)
    return sector.sector_month_yoy(ledger, star.star_sector_labels(spark), HALF_YEAR)


REFRESHED = (200003, 200005)


def _stored_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter options from the values that were stored with a ledger, month by month."""
    key = (spark.sparkContext.applicationId, sf_dir, "options")
    if key not in _STORED:
        columns = dict.fromkeys(("paid_on", *kpi.OPTIONS))
        path = _stored(spark, sf_dir, "options", lambda: star.star_ledger(spark, sf_dir, columns))
        write_values(spark, path, list(kpi.OPTIONS))
    return kpi.filter_options_of_values(read_values(spark, _STORED[key]))


def _refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report on a stored ledger of which two months were wrong and have been replaced."""
    key = (spark.sparkContext.applicationId, sf_dir, "refreshed")
    if key not in _STORED:
        ledger = star.star_ledger(spark, sf_dir, dict.fromkeys((*BASE, "sector", "payer")))
        late = F.date_format("paid_on", "yyyyMM").isin([str(m) for m in REFRESHED])
        early = ledger.withColumn("nominal", F.when(late, -1).otherwise(F.col("nominal")).cast("long"))
        path = _stored(spark, sf_dir, "refreshed", lambda: early)
        replace_months(ledger, path, REFRESHED)
    stored = read_ledger(spark, _STORED[key], HALF_YEAR)
    return _rounded(sector.sector_payer_yoy(stored, star.star_sector_labels(spark), HALF_YEAR))


#: Grains of the stored lattice: every payer, the code lists, and months alone.
GRAINS = {
    "payers": ("pay_year", "pay_month", *CATEGORIES, "npwp", "payer"),
    "codes": ("pay_year", "pay_month", *CATEGORIES),
    "months": ("pay_year", "pay_month"),
}


def _lattice(spark: SparkSession, sf_dir: str) -> LedgerLattice:
    """The lattice of a star, stored once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, "lattice")
    if key not in _STORED:
        path = scratch_path(spark, "lattice")
        columns = dict.fromkeys((*BASE, *(c for grain in GRAINS.values() for c in grain)))
        LedgerLattice.store(star.star_ledger(spark, sf_dir, columns), path, GRAINS)
        remove_at_exit(spark, path)
        _STORED[key] = path
    return LedgerLattice.open(spark, _STORED[key])


def _routed(build, *columns: str, flt: LedgerFilter, labels: bool = False) -> Query:
    """A report on the smallest stored grain that has its columns and those of its filter."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ledger = _lattice(spark, sf_dir).ledger(columns, flt)
        sides = [star.star_sector_labels(spark)] if labels else []
        return _rounded(build(ledger, *sides, flt=flt))

    return run


# Pages computed by this process: application, star and filter to reports.
_PAGES: dict[tuple[str, str, LedgerFilter], dict[str, DataFrame]] = {}


def _on_page(name: str, flt: LedgerFilter) -> Query:
    """A report of a page whose reports share one pass over the ledger."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, flt)
        if key not in _PAGES:
            ledger = star.star_ledger(spark, sf_dir, page.page_columns(flt))
            targets = star.star_targets(spark, sf_dir)
            _PAGES[key] = page.headline_page(ledger, targets, star.star_sector_labels(spark), flt)
        return _rounded(_PAGES[key][name])

    return run


def _with_date_text(report: Query) -> Query:
    """A report whose dates are text as day, month and year."""
    return lambda spark, sf_dir: report(spark, sf_dir).withColumn(
        "paid_on", F.date_format("paid_on", DATE_TEXT)
    )


def ledger_queries() -> dict[str, Query]:
    flt = {"flt": HALF_YEAR}
    labels, targets = ("labels",), ("targets",)
    payer_yoy = _report(sector.sector_payer_yoy, "payer", "sector", dims=labels, **flt)
    daily = _report(sector.sector_daily, "sector", **flt)
    top10 = _report(
        office.top10_payers_per_office, "pay_year", "npwp15", "payer", "office", **flt
    )
    return {
        "filter_options": _report(kpi.filter_options, *CATEGORIES, "payer"),
        "kpi_totals": _report(kpi.kpi_totals, **flt),
        "kpi_totals_chosen": _report(kpi.kpi_totals, *CATEGORIES, flt=CHOSEN),
        "kpi_cards": _report(kpi.kpi_cards, dims=targets, **flt),
        "kpi_cards_chosen": _report(kpi.kpi_cards, *CATEGORIES, dims=targets, flt=CHOSEN),
        "target_totals": _target_totals,
        "receipt_kind_yoy": _report(kpi.receipt_kind_yoy, "pay_year", **flt),
        "period_delta": _report(kpi.period_delta, dims=targets, **flt),
        "monthly_trend": _report(
            trend.monthly_trend, "pay_year", "pay_month", dims=targets, **flt
        ),
        "monthly_trend_chosen": _report(
            trend.monthly_trend,
            "pay_year",
            "pay_month",
            *CATEGORIES,
            dims=targets,
            flt=CHOSEN,
            target_scope="offices",
        ),
        "monthly_growth": _report(trend.monthly_growth, "pay_year", "pay_month", **flt),
        "monthly_growth_gross_as_refund": _report(
            trend.monthly_growth, "pay_year", "pay_month", refund_kinds=("MPN", "SPM"), **flt
        ),
        "monthly_growth_labels": _report(
            trend.monthly_growth, "pay_year", "pay_month", labels=True, **flt
        ),
        "sector_totals": _report(sector.sector_totals, "sector", dims=labels, **flt),
        "sector_totals_all_dates": _report(
            sector.sector_totals, "sector", dims=labels, flt=ALL_DATES
        ),
        "sector_yoy": _report(sector.sector_yoy, "sector", dims=labels, **flt),
        "sector_yoy_chosen": _report(sector.sector_yoy, *CATEGORIES, dims=labels, flt=CHOSEN),
        "sector_yoy_long_window": _report(sector.sector_yoy, "sector", dims=labels, flt=LONG),
        "sector_payer_yoy": payer_yoy,
        "sector_month_yoy": _report(
            sector.sector_month_yoy, "sector", "pay_month", dims=labels, **flt
        ),
        "sector_sparkline": _report(
            sector.sector_sparkline, "sector", "pay_month", dims=labels, **flt
        ),
        "sector_top10": _report(sector.sector_top10, "sector", dims=labels, **flt),
        "sector_daily": daily,
        "klu_contribution": _report(sector.klu_contribution, "sector", "klu", **flt),
        "sector_surplus_shortfall": _report(
            sector.sector_surplus_shortfall, "sector", dims=labels, **flt
        ),
        "sector_surplus_shortfall_by_growth": _report(
            sector.sector_surplus_shortfall,
            "sector",
            dims=labels,
            rank_by="growth_gross_pct",
            **flt,
        ),
        "sectors_with_other": _report(sector.sectors_with_other, "sector", dims=labels, **flt),
        "tax_type_yoy": _report(tax_type.tax_type_yoy, "tax_type", **flt),
        "tax_type_payer_yoy": _report(
            tax_type.tax_type_payer_yoy, "payer", "tax_type", "payer_kind", **flt
        ),
        "tax_type_top10": _report(tax_type.tax_type_top10, "tax_type", **flt),
        "tax_type_payer_top10": _report(
            tax_type.tax_type_payer_top10, "payer", "tax_type", "payer_kind", **flt
        ),
        "deposit_code_contribution": _report(
            tax_type.deposit_code_contribution, "tax_type", "deposit_code", **flt
        ),
        "payer_movers": _report(payer.payer_movers, "npwp", "payer", **flt),
        "payer_bands_gross": _report(payer.payer_bands_gross, "npwp", "payer", **flt),
        "payer_bands_gross_all_dates": _report(
            payer.payer_bands_gross, "npwp", "payer", flt=ALL_DATES
        ),
        "payer_bands_net": _report(payer.payer_bands_net, "npwp", "payer", **flt),
        "payer_bands_net_all_dates": _report(
            payer.payer_bands_net, "npwp", "payer", flt=ALL_DATES
        ),
        "largest_payers": _report(_largest_payers, "npwp", "payer"),
        "payer_totals_of_listed": _payers_with_debts,
        "kpi_totals_of_listed": _of_listed(kpi.kpi_totals),
        "sector_payer_yoy_of_listed": _of_listed(sector.sector_payer_yoy, "sector", labels=True),
        "top10_payers_per_office_of_listed": _of_listed(
            office.top10_payers_per_office, "pay_year", "npwp15", "office"
        ),
        "top10_payers_per_office_bucketed": _bucketed,
        "payer_totals": _report(payer.payer_totals, "npwp", "payer", **flt),
        "payer_totals_all_dates": _report(payer.payer_totals, "npwp", "payer", flt=ALL_DATES),
        "office_attainment": _report(office.office_attainment, "office", dims=targets, **flt),
        "office_attainment_mean": _report(
            office.office_attainment_mean, "office", dims=targets, **flt
        ),
        "top10_payers_per_office": top10,
        "top10_payers_per_office_chosen": _report(
            office.top10_payers_per_office,
            "pay_year",
            "npwp15",
            "payer",
            *CATEGORIES,
            flt=CHOSEN,
        ),
        "top10_payers_cluster": _report(
            office.top10_payers_cluster,
            "pay_year",
            "npwp15",
            "payer",
            "office",
            excluded_offices=LARGE_OFFICES,
            **flt,
        ),
        "officer_contribution": _report(
            _officers_of_2000, "office", "section", "officer"
        ),
        "subsector_yoy": _report(subsector.subsector_yoy, *HIERARCHY, **flt),
        "subsector_rollup": _report(subsector.subsector_rollup, *HIERARCHY, **flt),
        "subsector_rollup_of_sector": _report(
            subsector.subsector_rollup, *HIERARCHY, sector="BUILDING", **flt
        ),
        "klu_rollup": _report(subsector.klu_rollup, *HIERARCHY, **flt),
        "klu_rollup_of_sector": _report(
            subsector.klu_rollup, *HIERARCHY, sector="BUILDING", **flt
        ),
        "sector_tax_flow_nodes": _report(
            subsector.sector_tax_flow_nodes, "sector", "tax_type", **flt
        ),
        "sector_tax_flow_links": _report(
            subsector.sector_tax_flow_links, "sector", "tax_type", **flt
        ),
        "sector_tax_flow_links_all_dates": _report(
            subsector.sector_tax_flow_links, "sector", "tax_type", flt=ALL_DATES
        ),
        "subsector_flow_nodes": _report(subsector.subsector_flow_nodes, *HIERARCHY, **flt),
        "subsector_flow_links": _report(subsector.subsector_flow_links, *HIERARCHY, **flt),
        "subsector_flow_links_per_klu": _report(
            subsector.subsector_flow_links, *HIERARCHY, per_klu=True, **flt
        ),
        "payer_kind_receipts": _report(
            extras.payer_kind_receipts, "npwp15", dims=("master",), **flt
        ),
        "plan_vs_actual": _plan_vs_actual,
        "column_profile": _column_profile(payer_yoy),
        "column_profile_faceted": _faceted_profile(payer_yoy, FACETS),
        "column_profile_daily": _column_profile(daily),
        "column_profile_inferred": _inferred_profile(daily),
        "column_profile_date_text": _column_profile(_with_date_text(daily), (DATE_TEXT,)),
        "apply_column_filters": _filtered(
            payer_yoy,
            {
                "sector": cf.Membership(("BLDG", "HOME")),
                "gross_cy": cf.NumberRange(1_000_000, 30_000_000),
                "payer": cf.TextSearch("00[1-5]$"),
            },
        ),
        "apply_column_filters_daily": _filtered(
            daily,
            {
                "sector": cf.Membership(("MACHINERY", None)),
                "paid_on": cf.DateRange(dt.date(2000, 2, 10), dt.date(2000, 4, 20)),
            },
        ),
        "apply_column_filters_date_text": _filtered(
            _with_date_text(daily),
            {"paid_on": cf.DateRange(dt.date(2000, 2, 10), dt.date(2000, 4, 20))},
            (DATE_TEXT,),
        ),
        "export_report": _exported(top10, "parquet", ("office",)),
        "export_report_csv": _exported(daily, "csv"),
        "routed_monthly_growth": _routed(trend.monthly_growth, "pay_year", "pay_month", **flt),
        "routed_sector_yoy_chosen": _routed(sector.sector_yoy, "sector", flt=CHOSEN, labels=True),
        "routed_payer_totals": _routed(payer.payer_totals, "npwp", "payer", **flt),
        **{f"page_{name}": _on_page(name, HALF_YEAR) for name in page.HEADLINE},
        "page_kpi_cards_chosen": _on_page("kpi_cards", CHOSEN),
        "filter_options_stored": _stored_options,
        "ledger_table_refreshed": _refreshed,
        "ledger_table": _ledger_table,
        "ledger_table_compact": _ledger_table_compact,
    }


def queries() -> dict[str, Query]:
    """The reports, and the corpus operators with their pipeline where they are installed."""
    if corpus_queries is None:
        return ledger_queries()
    return ledger_queries() | corpus_queries.queries() | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for every report and for those corpus operators that SQL can express."""
    if corpus_oracle is None:
        return oracle_queries.build()
    return oracle_queries.build() | corpus_oracle.oracle_sql()


def entry(spark: SparkSession) -> DataFrame:
    """The flagship: the ten largest payers of every office with their growth."""
    return queries()["top10_payers_per_office"](spark, "/root/testdata/sf0.001")
