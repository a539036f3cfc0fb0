"""Profile of a report's columns and filters chosen per column."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A column with fewer distinct values is filtered by choosing among them; a
# number range is divided into this many steps.
FEW_VALUES = 10
RANGE_STEPS = 100

_ISO_DATE = r"^\d{4}-\d{2}-\d{2}"
# Fewer than FEW_VALUES values fill at most that many registers of the distinct-count sketch, so its
# estimate cannot exceed this bound; a larger estimate proves there are more values.
_SKETCH_BOUND = FEW_VALUES
# Items that the frequency sketch has room for; it is exact up to three quarters of them.
_TRACKED = 64

#: Date formats that are tried on text, each with the shape its values have. Of formats that all
#: values fit the first counts, so month before day.
DATE_FORMATS = {
    "M/d/yyyy[ HH:mm:ss]": r"^\d{1,2}/\d{1,2}/\d{4}",
    "d/M/yyyy[ HH:mm:ss]": r"^\d{1,2}/\d{1,2}/\d{4}",
    "yyyy/M/d[ HH:mm:ss]": r"^\d{4}/",
    "M-d-yyyy[ HH:mm:ss]": r"^\d{1,2}-\d{1,2}-\d{4}",
    "d-M-yyyy[ HH:mm:ss]": r"^\d{1,2}-\d{1,2}-\d{4}",
    "d.M.yyyy[ HH:mm:ss]": r"^\d{1,2}\.\d{1,2}\.\d{4}",
    "yyyyMMdd": r"^\d{8}$",
    "d MMM yyyy": r"^\d{1,2} \w{3} \d{4}$",
}


@dataclass(frozen=True)
class Membership:
    """Keep rows whose value is among ``values``; None stands for a missing value."""

    values: tuple


@dataclass(frozen=True)
class NumberRange:
    """Keep rows with ``low <= value <= high``."""

    low: float
    high: float


@dataclass(frozen=True)
class DateRange:
    """Keep rows with ``low <= value <= high``, comparing as timestamps."""

    low: dt.date | dt.datetime
    high: dt.date | dt.datetime


@dataclass(frozen=True)
class TextSearch:
    """Keep rows in which the regular expression is found; missing text is dropped."""

    pattern: str


ColumnFilter = Membership | NumberRange | DateRange | TextSearch


def _name(column: str) -> str:
    """A column name as an SQL identifier."""
    return "`" + column.replace("`", "``") + "`"


def _text(value: str) -> str:
    """A string as an SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _as_time(field: T.StructField, formats: Sequence[str]) -> str:
    """The column as a timestamp without time zone; NULL where it is none.

    Text is tried as an ISO date first and then by each of the formats.
    """
    name = _name(field.name)
    if not isinstance(field.dataType, T.StringType):
        return f"try_cast({name} as timestamp_ntz)"
    tries = [f"try_cast(if({name} rlike r'{_ISO_DATE}', {name}, null) as timestamp_ntz)"]
    for pattern in formats:
        tries.append(f"cast(try_to_timestamp({name}, {_text(pattern)}) as timestamp_ntz)")
    return f"coalesce({', '.join(tries)})"


def _is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def _guessed(field: T.StructField, number: int) -> tuple[list[str], list[str], list[str]]:
    """For a text column: readings by each date format, their sums, and what the sums show."""
    name, readings, sums, shown = _name(field.name), [], [], []
    for j, (pattern, shape) in enumerate(DATE_FORMATS.items()):
        read = f"_guess_{number}_{j}"
        shaped = f"if({name} rlike r'{shape}', {name}, null)"
        readings.append(
            f"cast(try_to_timestamp({shaped}, {_text(pattern)}) as timestamp_ntz) as {read}"
        )
        sums += [
            f"count({read}){{mask}} as votes_{number}_{j}",
            f"min({read}){{mask}} as first_{number}_{j}",
            f"max({read}){{mask}} as last_{number}_{j}",
        ]
        shown.append(
            f"if(present_{number} > 0 and votes_{number}_{j} = present_{number}, struct("
            f"{_text(pattern)} as format, first_{number}_{j} as first, last_{number}_{j} as last), null)"
        )
    return readings, sums, shown


def _profile(
    df: DataFrame, formats: Sequence[str], masks: Mapping[str, str], guess: bool
) -> DataFrame:
    """One aggregation over all columns; ``masks`` names the rows that count for a column.

    Few values are told exactly by two sketches. One estimates how many distinct values there
    are and proves where there are ten or more. The other has room for many more than ten items and
    is exact for those columns that remain; that its counts add up shows it left none out.
    """
    readings, sums, rows = [], [], []
    no_guess = "cast(array() as array<struct<format:string,first:timestamp_ntz,last:timestamp_ntz>>)"
    for i, field in enumerate(df.schema.fields):
        name, dtype = _name(field.name), field.dataType
        mask = f" filter (where {masks[field.name]})" if field.name in masks else ""
        present = f"{name} is not null" + (f" and {masks[field.name]}" if mask else "")
        sums += [
            f"count(*){mask} as rows_{i}",
            f"approx_count_distinct({name}){mask} as approx_{i}",
            f"count({name}){mask} as present_{i}",
            f"approx_top_k(cast({name} as string), {FEW_VALUES}, {_TRACKED})"
            f" filter (where {present}) as top_{i}",
        ]
        kind, low, high = "'text'", "cast(null as double)", "cast(null as double)"
        first = last = "cast(null as timestamp_ntz)"
        guesses = no_guess
        if isinstance(dtype, T.NumericType):
            kind, low, high = "'number'", f"low_{i}", f"high_{i}"
            sums += [
                f"cast(min({name}){mask} as double) as low_{i}",
                f"cast(max({name}){mask} as double) as high_{i}",
            ]
        elif _is_time(dtype) or isinstance(dtype, T.StringType):
            kind = f"if(present_{i} > 0 and times_{i} = present_{i}, 'date', 'text')"
            first, last = f"first_{i}", f"last_{i}"
            readings.append(f"{_as_time(field, formats)} as _time_{i}")
            sums += [
                f"count(_time_{i}){mask} as times_{i}",
                f"min(_time_{i}){mask} as first_{i}",
                f"max(_time_{i}){mask} as last_{i}",
            ]
            if guess and isinstance(dtype, T.StringType):
                read, votes, shown = _guessed(field, i)
                readings += read
                sums += [v.format(mask=mask) for v in votes]
                guesses = (
                    f"if(times_{i} = present_{i}, {no_guess}, array_compact(array({', '.join(shown)})))"
                )
        rows.append(
            f"struct({_text(field.name)} as column_name, rows_{i} as rows_left,"
            f" approx_{i} as approx, present_{i} as present, top_{i} as top,"
            f" {kind} as kind, {low} as low, {high} as high, {first} as first, {last} as last,"
            f" {guesses} as guesses)"
        )
    columns = df.selectExpr("*", *readings).selectExpr(*sums)
    columns = columns.selectExpr(f"inline(array({', '.join(rows)}))")
    few = (
        f"approx <= {_SKETCH_BOUND} and size(top) < {FEW_VALUES}"
        " and aggregate(top, 0L, (n, x) -> n + x.count) = present"
    )
    return (
        columns.withColumn("choices", F.expr(f"if({few}, array_sort(top.item), null)"))
        .withColumn("guessed", F.expr("kind = 'text' and size(guesses) > 0"))
        .withColumn("kind", F.expr("if(guessed, 'date', kind)"))
        .withColumn("first", F.expr("if(guessed, guesses[0].first, first)"))
        .withColumn("last", F.expr("if(guessed, guesses[0].last, last)"))
        .withColumn("filter_kind", F.expr("if(choices is not null, 'membership', kind)"))
        .selectExpr(
            "column_name",
            "filter_kind",
            "rows_left > present as has_missing",
            "choices",
            "if(filter_kind = 'number', low, null) as low",
            "if(filter_kind = 'number', high, null) as high",
            f"if(filter_kind = 'number', (high - low) / {RANGE_STEPS}, null) as step",
            "if(filter_kind = 'date', first, null) as first",
            "if(filter_kind = 'date', last, null) as last",
            "rows_left",
            "guesses.format as formats",
            "size(guesses) > 1 as ambiguous",
        )
    )


def column_profile(df: DataFrame, date_formats: Sequence[str] = ()) -> DataFrame:
    """How each column of a report can be filtered, one row per column.

    ``filter_kind`` is ``membership`` for fewer than ten distinct values (with the choices),
    ``number`` or ``date`` (with the range and, for numbers, the slider step) or ``text``.
    Text in which every value is a date counts as a date. ISO dates are recognised;
    ``date_formats`` lists further patterns such as ``dd/MM/yyyy``, tried in order.

    One pass over the report gives everything, distinct counts below ten exactly included, with a
    small state per column and task.
    """
    return _profile(df, date_formats, {}, False).drop("rows_left", "formats", "ambiguous")


def inferred_profile(df: DataFrame, date_formats: Sequence[str] = ()) -> DataFrame:
    """The profile, in which text is also a date if all its values fit one of ``DATE_FORMATS``.

    ``formats`` has all formats that every value fits, by which :func:`apply_column_filters` can
    read the column; the first one gives the range. ``ambiguous`` tells that there are several, such
    as month before day and day before month. ISO dates and ``date_formats`` go first and give none.
    """
    return _profile(df, date_formats, {}, True).drop("rows_left")


def faceted_profile(
    df: DataFrame, rules: Mapping[str, ColumnFilter], date_formats: Sequence[str] = ()
) -> DataFrame:
    """The profile while columns are filtered one after the other.

    Each column named in ``rules`` is profiled over the rows that the rules before it leave, so its
    own rule doesn't narrow its choices, and every other column over the rows that all rules
    leave. ``rows_left`` is the number of those rows. Still one pass: a mask for each rule.
    """
    tests = [F.coalesce(_predicate(df, n, r, date_formats), F.lit(False)) for n, r in rules.items()]
    steps = [reduce(and_, tests[: i + 1]).alias(f"_mask_{i + 1}") for i in range(len(tests))]
    masks = {name: f"_mask_{len(tests)}" for name in df.columns} if tests else {}
    masks |= {name: f"_mask_{i}" for i, name in enumerate(rules)}
    masks = {name: mask for name, mask in masks.items() if mask != "_mask_0"}
    masked = df.select("*", *steps)
    profile = _profile(masked, date_formats, masks, False).drop("formats", "ambiguous")
    return profile.where(~F.col("column_name").isin([f"_mask_{i + 1}" for i in range(len(tests))]))


def _predicate(df: DataFrame, name: str, rule: ColumnFilter, formats: Sequence[str]) -> Column:
    column = F.col(_name(name))
    if isinstance(rule, Membership):
        present = [v for v in rule.values if v is not None]
        kept = column.isin(present) if present else F.lit(False)
        return kept | column.isNull() if None in rule.values else kept
    if isinstance(rule, NumberRange):
        return column.between(rule.low, rule.high)
    if isinstance(rule, DateRange):
        low, high = (
            F.lit(v.isoformat()).cast("timestamp_ntz") for v in (rule.low, rule.high)
        )
        return F.expr(_as_time(df.schema[name], formats)).between(low, high)
    return column.rlike(rule.pattern) if rule.pattern else F.lit(True)


def apply_column_filters(
    df: DataFrame, rules: Mapping[str, ColumnFilter], date_formats: Sequence[str] = ()
) -> DataFrame:
    """Rows of a report that satisfy the rule of every named column.

    Text compared with a date range is read as :func:`column_profile` reads it.
    """
    tests = [_predicate(df, name, rule, date_formats) for name, rule in rules.items()]
    return df.where(reduce(and_, tests, F.lit(True)))
