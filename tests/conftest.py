import datetime as dt
import functools
import pathlib
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import __spark_entry__  # noqa: E402
from ledgerlens import LedgerFilter  # noqa: E402
from ledgerlens.schema import LEDGER_SCHEMA  # noqa: E402
from ledgerlens.session import session_conf  # noqa: E402
from tests.check import executed_plan  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    builder = SparkSession.builder.master("local[8]").appName("ledgerlens-tests")
    for key, value in session_conf(shuffle_bytes=0, cores=8).items():
        builder = builder.config(key, value)
    builder = builder.config("spark.ui.enabled", "false")
    builder = builder.config("spark.checkpoint.dir", str(shared))
    builder = builder.config("spark.sql.warehouse.dir", str(shared / "warehouse"))
    session = builder.config("spark.sql.maxMetadataValueLength", "1000").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def run(spark):
    """Types, rows and final plan of a registered query on the small star, run once each."""
    queries = __spark_entry__.queries()

    @functools.cache
    def result(name):
        df = queries[name](spark, SF_DIR)
        rows = df.collect()
        return df.dtypes, rows, executed_plan(df)

    return result


@pytest.fixture(scope="session")
def flt():
    return LedgerFilter(dt.date(2000, 1, 1), dt.date(2000, 6, 30))


@pytest.fixture(scope="session")
def make_ledger(spark):
    """Ledger from short row dicts; columns not given get a default."""

    def build(*rows):
        complete = []
        for row in rows:
            day = row.get("paid_on", dt.date(2000, 3, 1))
            base = {
                "paid_on": day,
                "pay_year": day.year,
                "pay_month": day.month,
                "nominal": 1,
                "kind": "MPN",
                "office": "A",
                "section": "S1",
                "officer": "AR1",
                "tax_type": "T1",
                "deposit_code": "100",
                "sector": "X",
                "subsector": "X-1",
                "klu": "X-1-1",
                "segment": "BIG",
                "npwp": "N1",
                "npwp15": "91",
                "payer": "P1",
                "payer_kind": "OP",
            }
            complete.append({**base, **row})
        names = LEDGER_SCHEMA.fieldNames()
        return spark.createDataFrame([tuple(r[n] for n in names) for r in complete], LEDGER_SCHEMA)

    return build
