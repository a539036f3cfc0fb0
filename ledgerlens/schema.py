"""Ledger column names, types and receipt kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("paid_on", T.DateType(), False),
        T.StructField("pay_year", T.IntegerType(), False),
        T.StructField("pay_month", T.IntegerType(), False),
        T.StructField("nominal", T.LongType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("office", T.StringType()),
        T.StructField("section", T.StringType()),
        T.StructField("officer", T.StringType()),
        T.StructField("tax_type", T.StringType()),
        T.StructField("deposit_code", T.StringType()),
        T.StructField("sector", T.StringType()),
        T.StructField("subsector", T.StringType()),
        T.StructField("klu", T.StringType()),
        T.StructField("segment", T.StringType()),
        T.StructField("npwp", T.StringType()),
        T.StructField("npwp15", T.StringType()),
        T.StructField("payer", T.StringType()),
        T.StructField("payer_kind", T.StringType()),
    ]
)

# Receipt kinds, the gross definitions built on them, and the
# prefix of placeholder taxpayer numbers.
KINDS = ("MPN", "SPM", "PBK KIRIM", "PBK TERIMA", "SPMKP")
GROSS_2_KINDS = ("MPN", "SPM")
GROSS_4_KINDS = ("MPN", "SPM", "PBK KIRIM", "PBK TERIMA")
REFUND_KIND = "SPMKP"
PLACEHOLDER_PREFIX = "000000000"

# Column names of an existing ledger table and the names used here.
LEGACY_COLUMNS = {
    "DATEBAYAR": "paid_on",
    "TAHUNBAYAR": "pay_year",
    "BULANBAYAR": "pay_month",
    "NOMINAL": "nominal",
    "KET": "kind",
    "ADMIN": "office",
    "SEKSI": "section",
    "NAMA_AR": "officer",
    "MAP": "tax_type",
    "KDBAYAR": "deposit_code",
    "NM_KATEGORI": "sector",
    "NM_GOLPOK": "subsector",
    "NAMA_KLU": "klu",
    "SEGMENTASI_WP": "segment",
    "NPWP": "npwp",
    "NPWP15": "npwp15",
    "NAMA_WP": "payer",
    "JENIS_WP": "payer_kind",
}


def from_legacy_columns(df: DataFrame) -> DataFrame:
    """Rename and cast the columns of an existing ledger table to the ledger schema.

    Columns the ledger does not know are left out; missing ones are simply absent,
    so a report fails at analysis time when it needs one of them.
    """
    types = {f.name: f.dataType for f in LEDGER_SCHEMA}
    return df.select(
        *[
            F.col(f"`{old}`").cast(types[new]).alias(new)
            for old, new in LEGACY_COLUMNS.items()
            if old in df.columns
        ]
    )
