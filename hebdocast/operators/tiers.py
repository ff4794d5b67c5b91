"""Stage 6 — split products into high-volume and sparse tiers."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import HIGH_VOLUME, SPARSE


def tier_products(weekly_or_featured: DataFrame, threshold: int = 10,
                  as_of: _dt.date | None = None) -> DataFrame:
    """Per-product transaction and quantity totals and the tier label.

    The panel's filled weeks add zeros only, so the weekly table gives the same
    totals as the featured panel with far fewer rows. With ``as_of`` only weeks up
    to it count; a product that starts later has totals of 0.
    """
    seen = F.lit(True) if as_of is None else F.col("WeekStart") <= F.lit(as_of)
    agg = weekly_or_featured.groupBy("ProductID").agg(
        F.sum(F.when(seen, F.col("transaction_count")).otherwise(0)).cast("long").alias("transaction_count"),
        F.sum(F.when(seen, F.col("Sales_Qty")).otherwise(0.0)).alias("total_sales_qty"))
    return agg.withColumn(
        "tier", F.when(F.col("transaction_count") >= threshold, F.lit(HIGH_VOLUME))
        .otherwise(F.lit(SPARSE)))


def tier_violations(tiers: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Duplicate product, missing/unknown tier, and (given the product universe)
    products without a tier. Must be empty."""
    dup = (tiers.groupBy("ProductID").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
           .select("ProductID", F.lit("duplicate").alias("violation")))
    bad = (tiers.where(F.col("ProductID").isNull() | F.col("tier").isNull()
                       | ~F.col("tier").isin(HIGH_VOLUME, SPARSE))
           .select("ProductID", F.lit("no_tier").alias("violation")))
    out = dup.unionByName(bad)
    if universe is not None:
        gap = (universe.select("ProductID").distinct()
               .join(tiers.select("ProductID"), "ProductID", "left_anti")
               .select("ProductID", F.lit("gap").alias("violation")))
        out = out.unionByName(gap)
    return out


def tier_audit(tiers: DataFrame) -> DataFrame:
    hv = F.col("tier") == HIGH_VOLUME
    return tiers.agg(
        F.count(F.lit(1)).alias("products"),
        F.count_if(hv).alias("high_volume_products"),
        F.count_if(~hv).alias("sparse_products"),
        F.coalesce(F.try_divide(F.sum(F.when(hv, F.col("total_sales_qty")).otherwise(0.0)),
                                F.sum("total_sales_qty")), F.lit(0.0))
        .alias("high_volume_volume_share"),
    )


def rows_of(df: DataFrame, tiers: DataFrame, tier: str) -> DataFrame:
    """Rows of a tier's products."""
    return df.join(tier_ids(tiers, tier), "ProductID", "left_semi")


def tier_ids(tiers: DataFrame, tier: str) -> DataFrame:
    return tiers.where(F.col("tier") == tier).select("ProductID")
