"""Ledger and side tables derived from an order star schema in Parquet."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.dims import SECTOR_LABELS_COLUMNS, local_table
from ledgerlens.schema import LEDGER_SCHEMA
from ledgerlens.session import fits_broadcast

# The columns used here, given so that opening a table reads no file footer.
_SCHEMAS = {
    "nation": "n_nationkey int, n_name string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,"
    " c_mktsegment string",
    "part": "p_partkey bigint, p_brand string, p_type string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_extendedprice double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}

# Ledger column -> expression, grouped by the table that has to be joined to reach it.
_FROM_LINEITEM = {
    "paid_on": "cast(l_shipdate as date)",
    "pay_year": "cast(year(l_shipdate) as int)",
    "pay_month": "cast(month(l_shipdate) as int)",
    # Rounding half away from zero on either sign, without a decimal object per row: the cast
    # cuts off the fraction. Reports repeat this in every conditional sum, so it is kept short.
    "nominal": "cast(l_extendedprice * 100 + 0.5D * sign(l_extendedprice) as bigint)"
    " * (case when l_returnflag = 'R' then -1 else 1 end)",
    "kind": "case when l_returnflag = 'N' then 'MPN'"
    " when l_returnflag = 'A' and l_linestatus = 'F' then 'SPM'"
    " when l_returnflag = 'A' and l_linestatus = 'O' then 'PBK TERIMA'"
    " when l_returnflag = 'R' and l_linestatus = 'F' then 'PBK KIRIM'"
    " when l_returnflag = 'R' and l_linestatus = 'O' then 'SPMKP' end",
}
_FROM_ORDERS = {
    "section": "concat('S', cast(o_custkey % 6 as string))",
    "officer": "concat('AR', cast(o_custkey % 40 as string))",
    "segment": "case when o_orderpriority = '4-NOT SPECIFIED' then '' else o_orderpriority end",
    "npwp": "concat('N', cast(o_custkey as string))",
    "npwp15": "case when o_custkey % 50 = 0 then concat('000000000', cast(o_custkey as string))"
    " else concat('9', cast(1000000 + o_custkey as string)) end",
}
_FROM_CUSTOMER = {
    "sector": "case when c_custkey % 97 = 0 then null else c_mktsegment end",
    "subsector": "concat(c_mktsegment, '-', cast(c_nationkey % 4 as string))",
    "klu": "concat(c_mktsegment, '-', cast(c_nationkey % 4 as string), '-',"
    " cast(c_custkey % 10 as string))",
    "payer": "c_name",
    "payer_kind": "case when c_acctbal < 0 then 'BADAN' when c_custkey is not null then 'OP' end",
}
_FROM_NATION = {"office": "n_name"}
_FROM_PART = {"tax_type": "p_type", "deposit_code": "p_brand"}


def read_table(
    spark: SparkSession, directory: str, name: str, bucketed: Mapping[str, str] | None = None
) -> DataFrame:
    """One Parquet table of the star, or the catalog table that ``bucketed`` names for it."""
    if bucketed and name in bucketed:
        return spark.table(bucketed[name])
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{directory}/{name}.parquet")


def store_bucketed(
    spark: SparkSession, directory: str, path: str, prefix: str, buckets: int
) -> dict[str, str]:
    """Store payments and orders in buckets by order; the catalog names, for :func:`star_ledger`.

    Both tables are shuffled once, here; afterwards payments meet their orders bucket by bucket,
    sorted, without an exchange. Take as many buckets as a join would have shuffle partitions:
    below ``spark.sql.shuffle.partitions`` Spark may prefer to shuffle. A bucket is read by one
    task, so a star in which single orders hold a large part of the payments is better left as it
    is, where adaptive execution splits hot keys.
    """
    names = {}
    for name, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
        names[name] = f"{prefix}_{name}"
        rows = read_table(spark, directory, name).repartition(buckets, key)
        writer = rows.write.bucketBy(buckets, key).sortBy(key).option("path", f"{path}/{name}")
        writer.saveAsTable(names[name])
    return names


def star_ledger(
    spark: SparkSession,
    directory: str,
    columns: Iterable[str] | None = None,
    bucketed: Mapping[str, str] | None = None,
) -> DataFrame:
    """The ledger over the star, joining only the tables the wanted columns come from.

    Joins are left joins on the key of the other table: a row whose order, customer, nation
    or part is absent stays, with NULL in what would come from there, and a table none of
    whose columns is wanted is not joined. So every report sees the same rows. Orders too large
    for a broadcast get their customer and nation first and the payments are joined with the
    result, so the payments move once by order, and once by part if that is asked for. Smaller
    orders are joined as they are, since Spark knows the size of a table and not that of
    a join, and the payments do not move at all. Joins carry no hints: sides below the broadcast
    threshold are broadcast, larger ones are shuffled on their key and adaptive execution splits
    hot keys. With ``bucketed``, from :func:`store_bucketed`, payments are not shuffled by order.
    """
    wanted = list(columns) if columns is not None else LEDGER_SCHEMA.fieldNames()
    unknown = set(wanted) - set(LEDGER_SCHEMA.fieldNames())
    if unknown:
        raise ValueError(f"not ledger columns: {sorted(unknown)}")
    needs = set(wanted)

    rows = read_table(spark, directory, "lineitem", bucketed)
    available = dict(_FROM_LINEITEM)
    via_nation = needs & _FROM_NATION.keys()
    via_customer = needs & _FROM_CUSTOMER.keys()
    if via_nation or via_customer or needs & _FROM_ORDERS.keys():
        orders = read_table(spark, directory, "orders", bucketed)
        available.update(_FROM_ORDERS)
        by_order = F.col("l_orderkey") == F.col("o_orderkey")
        by_customer = F.col("o_custkey") == F.col("c_custkey")
        customer = None
        if via_nation or via_customer:
            customer = read_table(spark, directory, "customer")
            available.update(_FROM_CUSTOMER)
        if via_nation:
            nation = read_table(spark, directory, "nation")
            customer = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            available.update(_FROM_NATION)
        if customer is None:
            rows = rows.join(orders, by_order, "left")
        elif fits_broadcast(spark, f"{directory}/orders.parquet"):
            rows = rows.join(orders, by_order, "left").join(customer, by_customer, "left")
        else:
            rows = rows.join(orders.join(customer, by_customer, "left"), by_order, "left")
    if needs & _FROM_PART.keys():
        part = read_table(spark, directory, "part")
        rows = rows.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        available.update(_FROM_PART)
    return rows.select(*[F.expr(available[name]).alias(name) for name in wanted])


def star_targets(spark: SparkSession, directory: str) -> DataFrame:
    """Office targets: one row per nation."""
    return read_table(spark, directory, "nation").selectExpr(
        "n_name as office",
        "cast((n_nationkey + 1) * 100000000L as bigint) as target_cy",
        "cast((n_nationkey + 1) * 90000000L as bigint) as target_py",
    )


def star_sector_labels(spark: SparkSession) -> DataFrame:
    """Short names of the market segments; MACHINERY has none on purpose."""
    return local_table(
        spark,
        [("FURNITURE", "FURN"), ("BUILDING", "BLDG"), ("AUTOMOBILE", "AUTO"), ("HOUSEHOLD", "HOME")],
        SECTOR_LABELS_COLUMNS,
    )


def star_payer_master(spark: SparkSession, directory: str) -> DataFrame:
    """Taxpayer master: one row per customer."""
    return read_table(spark, directory, "customer").selectExpr(
        _FROM_ORDERS["npwp15"].replace("o_custkey", "c_custkey") + " as npwp15",
        _FROM_CUSTOMER["payer_kind"] + " as payer_kind",
    )


def star_plan(spark: SparkSession, directory: str) -> DataFrame:
    """Plan amounts: order totals by month and priority."""
    return read_table(spark, directory, "orders").selectExpr(
        "cast(month(o_orderdate) as int) as pay_month",
        "o_orderpriority as plan_kind",
        "cast(o_totalprice * 100 + 0.5D * sign(o_totalprice) as bigint) as amount",
    )
