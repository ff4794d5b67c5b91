"""Stage 4 — weekly aggregation per (ProductID, Monday week).

One hash aggregate produces the numeric sums, the transaction count, the five
categorical modes and — folded into the same pass — the day-of-week features
that the feature stage needs, so no second scan or join of transactions is
required later. ``mode`` keeps value->count maps, and few transactions share a
product's week: maps made before the exchange would be larger than the rows. So
the rows themselves are dealt out by (ProductID, WeekStart), with the columns the
aggregate reads; a hot product is still spread over its weeks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CATEGORICAL_MODE_COLUMNS
from ..functions.columns import mode_lowest, week_floor, weekday_mon0

WEEKLY_COLUMNS = (
    "ProductID", "WeekStart", "Sales_Qty", "Sales_USD", "returns_exceeded_sales",
    "transaction_count", *CATEGORICAL_MODE_COLUMNS,
)
DOW_COLUMNS = ("dominant_dow", "pct_weekend_orders")


def with_week(tx: DataFrame) -> DataFrame:
    return tx.withColumn("WeekStart", week_floor("Order Date"))


def dealt_by_week(tx: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of the transactions with their week, each product's week in one partition."""
    return with_week(tx).select("ProductID", "WeekStart", *columns).repartition("ProductID", "WeekStart")


def week_floor_violations(tx: DataFrame) -> DataFrame:
    return tx.where(F.col("Order Date").isNull())


def weekly_extended(scoped: DataFrame) -> DataFrame:
    """Weekly rows plus dominant_dow / pct_weekend_orders (13 columns)."""
    dow = weekday_mon0("Order Date")
    aggs = [
        F.coalesce(F.sum("Sales Qty"), F.lit(0.0)).alias("_qty_raw"),
        F.coalesce(F.sum("Sales USD"), F.lit(0.0)).alias("Sales_USD"),
        F.count(F.lit(1)).alias("transaction_count"),
        *[mode_lowest(c).alias(c) for c in CATEGORICAL_MODE_COLUMNS],
        mode_lowest(dow).cast("double").alias("dominant_dow"),
        F.avg(dow.isin(5, 6).cast("double")).alias("pct_weekend_orders"),
    ]
    rows = dealt_by_week(scoped, "Order Date", "Sales Qty", "Sales USD", *CATEGORICAL_MODE_COLUMNS)
    g = rows.groupBy("ProductID", "WeekStart").agg(*aggs)
    return g.select(
        "ProductID", "WeekStart",
        F.greatest(F.col("_qty_raw"), F.lit(0.0)).alias("Sales_Qty"),
        "Sales_USD",
        (F.col("_qty_raw") < 0).alias("returns_exceeded_sales"),
        "transaction_count",
        *[F.col(c) for c in CATEGORICAL_MODE_COLUMNS],
        *DOW_COLUMNS,
    )


def weekly(scoped: DataFrame) -> DataFrame:
    return weekly_extended(scoped).select(*WEEKLY_COLUMNS)


def weekly_modes(scoped: DataFrame) -> DataFrame:
    """Only the five categorical modes per (ProductID, WeekStart)."""
    return (dealt_by_week(scoped, *CATEGORICAL_MODE_COLUMNS).groupBy("ProductID", "WeekStart")
            .agg(*[mode_lowest(c).alias(c) for c in CATEGORICAL_MODE_COLUMNS]))


def weekly_sums(scoped: DataFrame) -> DataFrame:
    """Numeric part: raw sums (nulls -> 0) and row counts."""
    return (with_week(scoped).groupBy("ProductID", "WeekStart")
            .agg(F.coalesce(F.sum("Sales Qty"), F.lit(0.0)).alias("Sales_Qty_raw"),
                 F.coalesce(F.sum("Sales USD"), F.lit(0.0)).alias("Sales_USD"),
                 F.count(F.lit(1)).alias("transaction_count")))


def day_of_week_features(scoped: DataFrame) -> DataFrame:
    dow = weekday_mon0("Order Date")
    return (with_week(scoped).where(F.col("Order Date").isNotNull())
            .groupBy("ProductID", "WeekStart")
            .agg(mode_lowest(dow).cast("double").alias("dominant_dow"),
                 F.avg(dow.isin(5, 6).cast("double")).alias("pct_weekend_orders")))


def weekly_violations(weekly_df: DataFrame) -> DataFrame:
    """Duplicate keys or negative quantity (must be empty)."""
    dup = (weekly_df.groupBy("ProductID", "WeekStart").agg(F.count(F.lit(1)).alias("n"))
           .where(F.col("n") > 1)
           .select("ProductID", "WeekStart", F.lit("duplicate_key").alias("violation")))
    neg = (weekly_df.where(F.col("Sales_Qty") < 0)
           .select("ProductID", "WeekStart", F.lit("negative_qty").alias("violation")))
    return dup.unionByName(neg)


def weekly_audit(scoped: DataFrame, weekly_df: DataFrame) -> DataFrame:
    s = scoped.agg(F.count(F.lit(1)).alias("scoped_rows"))
    w = weekly_df.agg(
        F.count(F.lit(1)).alias("weekly_rows"),
        F.count_if("returns_exceeded_sales").alias("returns_exceeded_sales_weeks"),
        F.min("WeekStart").alias("min_week"),
        F.max("WeekStart").alias("max_week"),
    )
    key = F.lit(1).alias("_k")
    return s.select(key, "*").join(w.select(key, "*"), "_k").drop("_k")
