"""Forecast assembly: one chosen model per tier, one table, hard guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import HIGH_VOLUME, SPARSE

OUTPUT_COLUMNS = ("ProductID", "forecast_week", "WeekStart", "predicted_Sales_Qty", "tier", "model")


def select_high_volume(hv_fc: DataFrame, model: str) -> DataFrame:
    return (hv_fc.where(F.col("model") == model).withColumn("tier", F.lit(HIGH_VOLUME))
            .select(*OUTPUT_COLUMNS))


def select_sparse(sparse_fc: DataFrame, model: str) -> DataFrame:
    """Chosen model, ``forecast_week`` = rank of the week within the product."""
    w = Window.partitionBy("unique_id").orderBy("ds")
    return (sparse_fc.where(F.col("model") == model)
            .withColumn("forecast_week", F.row_number().over(w).cast("long"))
            .select(F.col("unique_id").alias("ProductID"), "forecast_week",
                    F.col("ds").alias("WeekStart"), F.col("y_pred").alias("predicted_Sales_Qty"),
                    F.lit(SPARSE).alias("tier"), "model"))


def assemble(hv_sel: DataFrame, sparse_sel: DataFrame) -> DataFrame:
    """Union of both tiers; ordering is left to the sink (``sorted_for_sink``)."""
    return hv_sel.unionByName(sparse_sel)


def sorted_for_sink(fc: DataFrame) -> DataFrame:
    return fc.orderBy("tier", "ProductID", "forecast_week")


def forecast_violations(fc: DataFrame, tiers: DataFrame, horizon: int) -> DataFrame:
    """Missing products, wrong row counts, negative values (must be empty). The forecast is counted in one pass: a
    product's rows and negative values meet its entries in ``tiers``."""
    counts = fc.groupBy("ProductID").agg(F.count(F.lit(1)).alias("_rows"), F.count_if(F.col("predicted_Sales_Qty") < 0).alias("_neg"))
    wanted = tiers.groupBy("ProductID").agg(F.count(F.lit(1)).alias("_entries"))
    times = lambda name, n: F.array_repeat(F.lit(name), F.coalesce(n, F.lit(0)).cast("int"))
    found = F.concat(times("missing", F.when(F.col("_rows").isNull(), F.col("_entries"))),
                     times("row_count", F.when(F.col("_rows") != horizon, F.lit(1))), times("negative", F.col("_neg")))
    return wanted.join(counts, "ProductID", "full_outer").select("ProductID", F.explode(found).alias("violation"))
