"""Every registered query against its SQL on the smallest data set."""

import pytest

import __spark_entry__ as registry
from tests.check import connect, row_differences
from tests.conftest import SF_DIR

QUERIES = registry.ledger_queries()
SQL = registry.oracle_queries.build()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_matches_sql(run, duck, name):
    dtypes, rows, _ = run(name)
    assert row_differences(dtypes, rows, duck, SQL[name]) is None


def test_entry_returns_ten_payers_per_office(spark):
    rows = registry.entry(spark).collect()
    assert rows
    assert all(row["rank"] <= 10 for row in rows)
