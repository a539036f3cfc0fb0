"""Small reference dimensions: yearly office targets and short sector names."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

TARGETS_COLUMNS = {"office": pa.string(), "target_cy": pa.int64(), "target_py": pa.int64()}
SECTOR_LABELS_COLUMNS = {"sector": pa.string(), "label": pa.string()}

# Fixed values: (office, target 2023, target 2022).
OFFICE_TARGETS = [
    ("001", 608265424000, 477310544000),
    ("002", 542401593000, 1180601400000),
    ("003", 1150993826000, 1001261091000),
    ("004", 843373880000, 679223200000),
    ("005", 1481697044000, 1041766662000),
    ("007", 11518776933000, 8574702940000),
    ("008", 616125873000, 608619845000),
    ("009", 1634143550000, 1200824695000),
    ("097", 9205955757000, 7892063178000),
]

# Fixed values: (sector as stored, short name shown in reports).
SECTOR_LABELS = [
    ("PERTANIAN, KEHUTANAN DAN PERIKANAN", "PERTANIAN, KEHUTANAN DAN PERIKANAN"),
    ("PEJABAT NEGARA, KARYAWAN, PENSIUNAN, TIDAK/BELUM BEKERJA", "PEJABAT NEGARA, KARYAWAN, PENSIUNAN"),
    ("AKTIVITAS PROFESIONAL, ILMIAH DAN TEKNIS", "AKTIVITAS PROFESIONAL, ILMIAH DAN TEKNIS"),
    ("AKTIVITAS JASA LAINNYA", "AKTIVITAS JASA LAINNYA"),
    ("AKTIVITAS BADAN INTERNASIONAL DAN BADAN EKSTRA INTERNASIONAL LAINNYA", "BADAN INTER DAN EXTRA INTERNASIONAL"),
    ("INFORMASI DAN KOMUNIKASI", "INFORMASI DAN KOMUNIKASI"),
    ("PENGADAAN LISTRIK, GAS, UAP/AIR PANAS DAN UDARA DINGIN", "PENGADAAN LISTRIK, GAS, UAP/AIR PANAS DAN UDARA DINGIN"),
    ("ADMINISTRASI PEMERINTAHAN, PERTAHANAN DAN JAMINAN SOSIAL WAJIB", "ADMIN. PEMERINTAHAN & JAMINAN SOSIAL"),
    ("PERDAGANGAN BESAR DAN ECERAN; REPARASI DAN PERAWATAN MOBIL DAN SEPEDA MOTOR", " PERDAGANGAN BESAR ECERAN & PERAWATAN MOBIL"),
    ("AKTIVITAS KEUANGAN DAN ASURANSI", "AKTIVITAS KEUANGAN DAN ASURANSI"),
    ("KONSTRUKSI", "KONSTRUKSI"),
    ("AKTIVITAS KESEHATAN MANUSIA DAN AKTIVITAS SOSIAL", "KESEHATAN MANUSIA & AKTIVITAS SOSIAL"),
    ("TREATMENT AIR, TREATMENT AIR LIMBAH, TREATMENT DAN PEMULIHAN MATERIAL SAMPAH, DAN AKTIVITAS REMEDIASI", "TREATMENT AIR,LIMBAH"),
    ("PENDIDIKAN", "PENDIDIKAN"),
    ("KESENIAN, HIBURAN DAN REKREASI", "KESENIAN, HIBURAN DAN REKREASI"),
    ("PENGANGKUTAN DAN PERGUDANGAN", "PENGANGKUTAN DAN PERGUDANGAN"),
    ("REAL ESTAT", "REAL ESTAT"),
    ("", ""),
    ("INDUSTRI PENGOLAHAN", "INDUSTRI PENGOLAHAN"),
    ("PENYEDIAAN AKOMODASI DAN PENYEDIAAN MAKAN MINUM", "PENYEDIAAN AKOMODASI DAN PENYEDIAAN MAKAN MINUM"),
    ("PERTAMBANGAN DAN PENGGALIAN", "PERTAMBANGAN DAN PENGGALIAN"),
    ("AKTIVITAS PENYEWAAN DAN SEWA GUNA USAHA TANPA HAK OPSI, KETENAGAKERJAAN, AGEN PERJALANAN DAN PENUNJANG USAHA LAINNYA", "PENYEWAAN & SGU TANPA HAK OPSI"),
    ("AKTIVITAS RUMAH TANGGA SEBAGAI PEMBERI KERJA; AKTIVITAS YANG MENGHASILKAN BARANG DAN JASA OLEH RUMAH TANGGA YANG DIGUNAKAN UNTUK MEMENUHI KEBUTUHAN SENDIRI", "RUMAH TANGGA PEMBERI KERJA"),
]


def local_table(
    spark: SparkSession, rows: Sequence[tuple], columns: dict[str, pa.DataType]
) -> DataFrame:
    """A few rows as a DataFrame whose size the optimizer knows.

    Built from Arrow data the rows become a local relation, so a join with them is planned
    as a broadcast from the start; built from Python rows their size would count as unknown.
    """
    schema = pa.schema(list(columns.items()))
    data = [dict(zip(columns, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(data, schema=schema))


def office_targets(spark: SparkSession) -> DataFrame:
    """The published office targets; their sum is the regional target."""
    return local_table(spark, OFFICE_TARGETS, TARGETS_COLUMNS)


def sector_labels(spark: SparkSession) -> DataFrame:
    """The short sector names."""
    return local_table(spark, SECTOR_LABELS, SECTOR_LABELS_COLUMNS)
