"""Country drill-down: forecasts keyed on (ProductID, Country) from scoped
transactions (the weekly table keeps only one modal country per week)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import week_floor


def country_fanout(scoped: DataFrame, limit: int = 2) -> DataFrame:
    """Max distinct countries of one product and products above ``limit``."""
    per = scoped.groupBy("ProductID").agg(F.countDistinct("Country").alias("n_countries"))
    return per.agg(F.max("n_countries").cast("long").alias("max_distinct_countries"),
                   F.count_if(F.col("n_countries") > limit).alias("products_over_limit"))


def country_violations_over_limit(scoped: DataFrame, limit: int = 2) -> DataFrame:
    per = scoped.groupBy("ProductID").agg(F.countDistinct("Country").alias("n_countries"))
    return per.where(F.col("n_countries") > limit)


def country_weekly(scoped: DataFrame, product_ids: DataFrame | None = None) -> DataFrame:
    """Weekly quantity per (product, country, week), floored at 0; null
    countries form their own group."""
    src = scoped if product_ids is None else scoped.join(product_ids, "ProductID", "left_semi")
    return (src.withColumn("WeekStart", week_floor("Order Date"))
            .groupBy("ProductID", "Country", "WeekStart")
            .agg(F.greatest(F.coalesce(F.sum("Sales Qty"), F.lit(0.0)), F.lit(0.0))
                 .alias("Sales_Qty")))


def country_level(weekly_pc: DataFrame, window: int = 4) -> DataFrame:
    """Mean of each pair's last ``window`` observed weeks, floored at 0."""
    w = Window.partitionBy("ProductID", "Country").orderBy(F.col("WeekStart").desc())
    last = weekly_pc.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= window)
    return (last.groupBy("ProductID", "Country")
            .agg(F.greatest(F.avg("Sales_Qty"), F.lit(0.0)).alias("level"),
                 F.count(F.lit(1)).alias("weeks_used")))


def country_forecast(levels: DataFrame, origin: _dt.date, horizon: int,
                     window: int = 4) -> DataFrame:
    weeks = F.sequence(F.lit(origin), F.date_add(F.lit(origin), 7 * (horizon - 1)),
                       F.expr("INTERVAL 7 DAYS"))
    return (levels.select("ProductID", "Country", "level", F.posexplode(weeks).alias("_i", "WeekStart"))
            .select("ProductID", "Country", (F.col("_i") + 1).cast("long").alias("forecast_week"),
                    "WeekStart", F.col("level").alias("predicted_Sales_Qty"),
                    F.lit(f"rolling_mean_last_{window}_weeks").alias("method")))


def country_violations(fc: DataFrame, horizon: int) -> DataFrame:
    """Pairs without ``horizon`` rows or with negative values; a row when no
    pair exists at all."""
    per = (fc.groupBy("ProductID", "Country")
           .agg(F.count(F.lit(1)).alias("rows"), F.min("predicted_Sales_Qty").alias("lowest")))
    bad = per.where((F.col("rows") != horizon) | (F.col("lowest") < 0)).select(
        "ProductID", "Country", F.lit("pair").alias("violation"))
    none = (fc.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 0)
            .select(F.lit(None).cast("string").alias("ProductID"),
                    F.lit(None).cast("string").alias("Country"), F.lit("no_pairs").alias("violation")))
    return bad.unionByName(none)
