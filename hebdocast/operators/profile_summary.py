"""Headline counts of the raw-data profile as (metric, value) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import clean

# Labels of the profile's headline counts, in the published order.
LABELS = ("raw_rows", "raw_regions", "raw_countries", "cleaned_rows_post_dedup", "missing_order_date_rows_imputed",
          "negative_sales_qty_rows", "negative_sales_usd_rows", "cleaned_products", "in_scope_rows",
          "in_scope_products", "duplicate_rows_dropped")


def summary(flow) -> DataFrame:
    """One aggregate per source (raw, deduplicated, in scope), their rows joined and unpivoted."""
    kept = ~clean.artifact_predicate()
    raw = flow.raw.agg(
        F.count(F.lit(1)).alias("raw_rows"), F.countDistinct(F.when(kept, F.col("Region"))).alias("raw_regions"),
        F.countDistinct(F.when(kept, F.col("Country"))).alias("raw_countries"),
        F.count_if(F.col("Sales Qty") < 0).alias("negative_sales_qty_rows"),
        F.count_if(F.col("Sales USD") < 0).alias("negative_sales_usd_rows"), F.count_if(kept).alias("_kept"))
    prepared = flow.prepared.agg(
        F.count(F.lit(1)).alias("cleaned_rows_post_dedup"),
        F.count_if(F.col("Order Date").isNull()).alias("missing_order_date_rows_imputed"),
        F.countDistinct("ProductID").alias("cleaned_products"))
    scoped = flow.scoped.agg(F.count(F.lit(1)).alias("in_scope_rows"),
                             F.countDistinct("ProductID").alias("in_scope_products"))
    one = clean._one_row_pair(clean._one_row_pair(raw, prepared), scoped)
    one = one.withColumn("duplicate_rows_dropped", F.col("_kept") - F.col("cleaned_rows_post_dedup"))
    return one.select(*[F.col(c).cast("long").alias(c) for c in LABELS]).unpivot([], list(LABELS), "metric", "value")
