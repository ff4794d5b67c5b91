"""Transaction adapter over the TPC-H-shaped test tables.

Maps lineitem/orders/customer/nation/region/part onto the 14-column
transaction contract (FIXTURES.md §2): sign flips for returns, nulls for
missing order dates and ranges, padded lower-case ranges, exact duplicate
rows and the three export-artifact rows a workbook export carries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ARTIFACT_FOOTER_PREFIX, ARTIFACT_TOTAL_REGION
from .tables import read_table

TRANSACTION_SCHEMA = T.StructType([
    T.StructField("Region", T.StringType()),
    T.StructField("Country", T.StringType()),
    T.StructField("Customer Code", T.StringType()),
    T.StructField("Customer ID", T.StringType()),
    T.StructField("Brand Category", T.StringType()),
    T.StructField("Product Range", T.StringType()),
    T.StructField("Sales Channel", T.StringType()),
    T.StructField("Product Code", T.StringType()),
    T.StructField("Order Date", T.TimestampNTZType()),
    T.StructField("Invoice Date", T.TimestampNTZType()),
    T.StructField("Invoice No", T.StringType()),
    T.StructField("Sales USD", T.DoubleType()),
    T.StructField("Sales Qty", T.DoubleType()),
    T.StructField("Sales KG", T.DoubleType()),
])

# adapter rule constants (FIXTURES.md §2)
NULL_RANGE_MOD = 613
PROMO_LINE = 7
PADDED_RANGE_MOD = 5
NULL_ORDER_DATE_MOD = 431
RETURN_MOD = 17
DUPLICATE_MOD = 997


def _signed(neg: Column, value: Column) -> Column:
    return F.when(neg, -value).otherwise(value)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lineitem and copy with its part, in the narrow form in which it is shuffled by order."""
    li = read_table(spark, sf_dir, "lineitem", [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_shipdate"])
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_brand", "p_type", "p_size"])
    ok = F.col("l_orderkey")
    is_return = ((ok + F.col("l_linenumber")) % RETURN_MOD) == 0
    usd = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    kg = F.col("l_quantity") * F.col("p_size")
    copies = F.when(ok % DUPLICATE_MOD == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return li.join(part, li.l_partkey == part.p_partkey).select(
        ok.cast("string").alias("Invoice No"), "l_partkey", (F.col("l_suppkey") % 3).alias("_supp"),
        (F.col("l_linenumber") == PROMO_LINE).alias("_promo"), "p_brand", "p_type", "l_shipdate",
        _signed(is_return, usd).cast("double").alias("Sales USD"),
        _signed(is_return, F.col("l_quantity")).cast("double").alias("Sales Qty"),
        _signed(is_return, kg).cast("double").alias("Sales KG"),
        F.explode(copies).alias("_copy"), F.lit(None).cast("string").alias("_artifact")).drop("_copy")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with its customer and place."""
    orders = read_table(spark, sf_dir, "orders",
                        ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"])
    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey"])
    # nation and region are fixed-size dimensions (25 and 5 rows by definition)
    nation = F.broadcast(read_table(spark, sf_dir, "nation",
                                    ["n_nationkey", "n_name", "n_regionkey"]))
    region = F.broadcast(read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"]))
    geo = (customer.join(nation, customer.c_nationkey == nation.n_nationkey)
           .join(region, nation.n_regionkey == region.r_regionkey)
           .select("c_custkey", "c_name", "n_name", "r_name"))
    return orders.join(geo, orders.o_custkey == geo.c_custkey).select(
        F.col("o_orderkey").cast("string").alias("_order"), "o_orderdate", "o_orderpriority",
        "c_custkey", "c_name", "n_name", "r_name")


def artifact_rows(spark: SparkSession) -> DataFrame:
    """The three non-transaction rows an export appends: total, spacer, footer."""
    rows = [
        (ARTIFACT_TOTAL_REGION,) + (None,) * 13,
        (None,) * 14,
        (ARTIFACT_FOOTER_PREFIX + " none",) + (None,) * 13,
    ]
    return spark.createDataFrame(rows, TRANSACTION_SCHEMA)


def artifact_lines(lines: DataFrame) -> DataFrame:
    """The artifact rows as ``lines``: ``_artifact`` is the Region, empty for the spacer's null."""
    region = artifact_rows(lines.sparkSession).select(F.coalesce("Region", F.lit("")).alias("_artifact"))
    return region.select(*[F.col(f.name) if f.name == "_artifact" else F.lit(None).cast(f.dataType).alias(f.name)
                           for f in lines.schema.fields])


SOURCE_TABLES = ("lineitem", "orders", "customer", "nation", "region", "part")


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw transaction table: base rows, exact duplicates, artifact rows.

    Lines meet their part and orders their customer while they are narrow; then both sides are shuffled once by
    ``Invoice No``. That is a column of the result, so rows that are equal are in one partition and dropping them needs
    no exchange. For that the artifact rows come in before the join, without an order, and not behind it. Duplicates
    are produced by exploding a one- or two-element array on the same scan.
    """
    lines = _lines(spark, sf_dir)
    lines = lines.unionByName(artifact_lines(lines))
    orders = _orders(spark, sf_dir)
    j = lines.join(orders, lines["Invoice No"] == orders["_order"], "left").where(
        F.col("_order").isNotNull() | F.col("_artifact").isNotNull())
    ok = F.col("Invoice No").cast("long")
    product_range = (
        F.when(ok % NULL_RANGE_MOD == 0, F.lit(None).cast("string"))
        .when(F.col("_promo"), F.lit("PROMO"))
        .when(ok % PADDED_RANGE_MOD == 0, F.concat(F.lit(" "), F.lower("p_type")))
        .otherwise(F.col("p_type"))
    )
    product_code = F.concat(
        F.lpad(F.col("l_partkey").cast("string"), 5, "0"), F.lit("-"),
        F.lpad(F.col("_supp").cast("string"), 3, "0"), F.lit("-"),
        F.col("p_type"))
    return j.select(
        F.when(F.col("_artifact").isNull(), F.col("r_name"))
        .when(F.col("_artifact") != "", F.col("_artifact")).alias("Region"),
        F.col("n_name").alias("Country"),
        F.col("c_custkey").cast("string").alias("Customer Code"),
        F.col("c_name").alias("Customer ID"),
        F.col("p_brand").alias("Brand Category"),
        product_range.alias("Product Range"),
        F.col("o_orderpriority").alias("Sales Channel"),
        product_code.alias("Product Code"),
        F.when(ok % NULL_ORDER_DATE_MOD == 0, F.lit(None))
        .otherwise(F.col("o_orderdate")).cast("timestamp_ntz").alias("Order Date"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("Invoice Date"),
        "Invoice No", "Sales USD", "Sales Qty", "Sales KG")
