import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import column_filters as cf
from tests.check import executed_plan


def profile(df):
    return {r.column_name: r.asDict() for r in cf.column_profile(df).collect()}


def test_nine_values_are_a_choice_and_ten_are_not(spark):
    df = spark.range(2000).selectExpr(
        "cast(id % 9 as string) as nine",
        "cast(id % 10 as string) as ten",
        "cast(id as string) as many",
        "id % 9 as nine_n",
        "id as many_n",
    )
    p = profile(df)
    assert {k: v["filter_kind"] for k, v in p.items()} == {
        "nine": "membership", "ten": "text", "many": "text",
        "nine_n": "membership", "many_n": "number",
    }
    assert p["nine"]["choices"] == [str(i) for i in range(9)]
    assert p["ten"]["choices"] is None
    assert (p["many_n"]["low"], p["many_n"]["high"]) == (0.0, 1999.0)
    assert math.isclose(p["many_n"]["step"], 19.99)
    assert p["nine_n"]["low"] is None


def test_sketch_estimate_never_exceeds_its_bound(spark):
    """Whatever nine values a column holds, the first pass must not rule it out."""
    names = [f"c{i}" for i in range(20)]
    df = spark.range(900).selectExpr(
        *[f"hash(id % 9, {i}) as {name}" for i, name in enumerate(names)]
    )
    assert {v["filter_kind"] for v in profile(df).values()} == {"membership"}


def test_columns_just_above_the_limit_stay_exact(spark):
    names = [f"c{i}" for i in range(20)]
    df = spark.range(1000).selectExpr(
        *[f"cast(hash(id % 10, {i}) as string) as {name}" for i, name in enumerate(names)]
    )
    assert {v["filter_kind"] for v in profile(df).values()} == {"text"}


def test_dates_and_date_text(spark):
    df = spark.range(30).selectExpr(
        "date_add(date'2024-01-01', cast(id as int)) as d",
        "cast(date_add(date'2024-01-01', cast(id as int)) as string) as iso",
        "if(id = 3, 'n/a', cast(date_add(date'2024-01-01', cast(id as int)) as string)) as mixed",
        "cast(2000 + id as string) as code",
        "timestamp'2024-01-01 10:00:00' + make_interval(0, 0, 0, cast(id as int)) as t",
    )
    p = profile(df)
    assert {k: v["filter_kind"] for k, v in p.items()} == {
        "d": "date", "iso": "date", "mixed": "text", "code": "text", "t": "date",
    }
    assert p["iso"]["first"] == dt.datetime(2024, 1, 1)
    assert p["d"]["last"] == dt.datetime(2024, 1, 30)
    assert p["t"]["first"] == dt.datetime(2024, 1, 1, 10)


@pytest.mark.parametrize("pattern", ["dd/MM/yyyy", "yyyyMMdd"])
def test_date_text_in_other_formats(spark, pattern):
    days = [dt.date(2023, 1, 1) + dt.timedelta(days=7 * i) for i in range(12)]
    rows = spark.createDataFrame([(d,) for d in days], "d date").select(
        F.date_format("d", pattern).alias("d")
    )
    assert cf.column_profile(rows).first().filter_kind == "text"
    found = cf.column_profile(rows, (pattern,)).first()
    assert (found.filter_kind, found.first.date(), found["last"].date()) == ("date", days[0], days[-1])
    kept = cf.apply_column_filters(rows, {"d": cf.DateRange(days[2], days[4])}, (pattern,))
    assert kept.count() == 3


def test_missing_values(spark):
    df = spark.createDataFrame([("a", None), (None, None)], "s string, n double")
    p = profile(df)
    assert p["s"]["has_missing"] and p["s"]["choices"] == ["a"]
    assert p["n"]["filter_kind"] == "membership" and p["n"]["choices"] == []


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, "x.y")], "`a b` int, `c.d` string")
    assert set(profile(df)) == {"a b", "c.d"}
    assert cf.apply_column_filters(df, {"c.d": cf.TextSearch(r"x\.y")}).count() == 1


def kept(df, rules):
    return sorted(r.id for r in cf.apply_column_filters(df, rules).collect())


def test_filters(spark):
    df = spark.createDataFrame(
        [
            (1, "a+b", 1.5, dt.date(2024, 1, 1), "2024-01-01"),
            (2, "xa+by", None, dt.date(2024, 2, 1), "2024-02-01"),
            (3, None, 3.0, None, "n/a"),
            (4, "aab", 4.0, dt.date(2024, 3, 1), None),
        ],
        "id int, s string, x double, d date, iso string",
    )
    assert kept(df, {}) == [1, 2, 3, 4]
    assert kept(df, {"s": cf.Membership(("aab", None))}) == [3, 4]
    assert kept(df, {"s": cf.Membership(())}) == []
    assert kept(df, {"s": cf.Membership((None,))}) == [3]
    assert kept(df, {"x": cf.NumberRange(1.5, 3.0)}) == [1, 3]
    january = cf.DateRange(dt.date(2024, 1, 1), dt.date(2024, 2, 1))
    assert kept(df, {"d": january}) == [1, 2]
    assert kept(df, {"iso": january}) == [1, 2]
    morning = cf.DateRange(dt.datetime(2024, 1, 1, 0, 0, 1), dt.datetime(2024, 2, 1))
    assert kept(df, {"d": morning}) == [2]
    assert kept(df, {"s": cf.TextSearch("a+b")}) == [4]
    assert kept(df, {"s": cf.TextSearch(r"a\+b")}) == [1, 2]
    assert kept(df, {"s": cf.TextSearch("^a")}) == [1, 4]
    assert kept(df, {"s": cf.TextSearch("")}) == [1, 2, 3, 4]
    assert kept(df, {"s": cf.TextSearch("a"), "x": cf.NumberRange(0, 2)}) == [1]


@pytest.mark.parametrize("count", [0, 1, 9, 10, 11, 48, 49, 400])
def test_few_values_are_told_exactly(spark, count):
    rows = spark.range(3000).selectExpr(
        f"if(id % 7 = 0, null, id % {max(count, 1)}) as v" if count else "cast(null as bigint) as v",
        "cast(id as string) as many",
    )
    found = profile(rows.repartition(5))
    assert found["many"]["choices"] is None
    if count < cf.FEW_VALUES:
        assert found["v"]["choices"] == sorted(str(i) for i in range(count))
    else:
        assert found["v"]["choices"] is None and found["v"]["filter_kind"] == "number"


def test_profile_takes_one_pass(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id as string) as s").write.parquet(str(tmp_path / "t"))
    report = spark.read.parquet(str(tmp_path / "t"))
    for made in (
        cf.column_profile(report),
        cf.inferred_profile(report),
        cf.faceted_profile(report, {"id": cf.NumberRange(1, 50), "s": cf.TextSearch("1")}),
    ):
        made.collect()
        assert executed_plan(made).count("FileScan parquet") == 1


def test_facets_equal_filtering_step_by_step(spark):
    rows = spark.range(2000).selectExpr(
        "if(id % 11 = 0, null, id % 13) as a",
        "concat('t', id % 31) as b",
        "cast(id * 7 % 501 as double) as c",
        "date_add(date'2000-01-01', cast(id % 90 as int)) as d",
    )
    rules = {
        "b": cf.TextSearch("[1-7]$"),
        "a": cf.Membership((1, 2, 5, None)),
        "d": cf.DateRange(dt.date(2000, 1, 5), dt.date(2000, 2, 20)),
    }
    got = {r["column_name"]: r for r in cf.faceted_profile(rows, rules).collect()}
    left = rows
    for name, rule in [*rules.items(), ("c", None)]:
        want = {r["column_name"]: r for r in cf.column_profile(left).collect()}[name]
        assert got[name].asDict() == {**want.asDict(), "rows_left": left.count()}
        if rule:
            left = cf.apply_column_filters(left, {name: rule})
    assert set(got) == set(rows.columns)


def test_facets_without_rules_and_without_rows(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    plain = [r.asDict() for r in cf.column_profile(rows).collect()]
    got = cf.faceted_profile(rows, {}).collect()
    assert [r.asDict() for r in got] == [{**p, "rows_left": 2} for p in plain]
    none = {r["column_name"]: r for r in cf.faceted_profile(rows, {"a": cf.Membership((9,))}).collect()}
    assert none["b"]["rows_left"] == 0 and none["b"]["choices"] == [] and not none["b"]["has_missing"]
    assert none["a"]["rows_left"] == 2 and none["a"]["choices"] == ["1", "2"]


def inferred(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    (row,) = cf.inferred_profile(rows).collect()
    return row


def test_formats_are_inferred_from_all_values(spark):
    days = [dt.date(2001, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    row = inferred(spark, [None, *(d.strftime("%d/%m/%Y") for d in days)])
    assert row["filter_kind"] == "date" and row["formats"] == ["d/M/yyyy[ HH:mm:ss]"]
    assert not row["ambiguous"] and row["has_missing"]
    assert (row["first"].date(), row["last"].date()) == (days[0], days[-1])
    row = inferred(spark, [d.strftime("%m-%d-%Y 10:20:30") for d in days])
    assert row["formats"] == ["M-d-yyyy[ HH:mm:ss]"] and row["first"].hour == 10
    row = inferred(spark, [d.strftime("%Y%m%d") for d in days])
    assert row["formats"] == ["yyyyMMdd"] and row["last"].date() == days[-1]


def test_ambiguous_formats_are_stated_month_first(spark):
    row = inferred(spark, [f"{m:02}/{d:02}/2000" for m in range(1, 13) for d in range(1, 13)])
    assert row["ambiguous"] and row["formats"] == ["M/d/yyyy[ HH:mm:ss]", "d/M/yyyy[ HH:mm:ss]"]
    assert row["last"] == dt.datetime(2000, 12, 12)


def test_one_value_that_is_no_date_makes_text(spark):
    days = [f"{d}/1/2000" for d in range(1, 31)]
    assert inferred(spark, days)["filter_kind"] == "date"
    for odd in ("31/02/2000", "soon", "", "1.1.2000"):
        row = inferred(spark, [*days, odd])
        assert row["filter_kind"] == "text" and row["formats"] == [] and row["first"] is None


def test_iso_dates_and_named_formats_go_first(spark):
    days = [f"2000-01-{d:02}" for d in range(1, 29)]
    row = inferred(spark, days)
    assert row["filter_kind"] == "date" and row["formats"] == [] and not row["ambiguous"]
    rows = spark.createDataFrame([(f"{d}/{m}/2000",) for d in range(1, 13) for m in (1, 2)], "v string")
    (row,) = cf.inferred_profile(rows, ("d/M/yyyy",)).collect()
    assert row["last"] == dt.datetime(2000, 2, 12) and not row["ambiguous"]
