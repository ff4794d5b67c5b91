"""Leakage guard by provenance: a model input of a week may read nothing of that week or later.

Every row of the panel carries its week as the source of its values. A feature's source is the largest
source week among the rows that it reads: its frame in ``features.panel_reads``, from which the features
themselves are computed, and one row back for last week's copies. Every model input of every row must have a
source below the row's own week. One copy of the panel, all weeks, all inputs; the windows are those of the
features, on the same clustering by product. Calendar columns read nothing of the panel, and the product's
categories are its static attributes (see ``features.product_modes``); neither is checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CATEGORICAL_MODE_COLUMNS, Params
from . import features

TARGET_MEAN = "product_mean_qty"  # the product's mean over earlier weeks, its target encoding
TARGET_MEAN_READS = (Window.unboundedPreceding, -1)


def model_input_columns(params: Params) -> list[str]:
    """Model inputs for the configured feature mode (categoricals included)."""
    roll = [f"Sales_Qty_roll{s}_{w}" for w in params.windows for s in ("mean", "std")]
    lags = [features.lag_name(k) for k in params.lags]
    if params.feature_mode == "contemporaneous":
        same_week = ["dominant_dow", "pct_weekend_orders", "zero_streak_length",
                     "cumulative_zero_weeks", "unit_price"]
    else:
        same_week = ["dominant_dow_prev", "pct_weekend_orders_prev", "zero_streak_length_prev",
                     "cumulative_zero_weeks_prev"]
    return [*CATEGORICAL_MODE_COLUMNS, *lags, *roll, *same_week, *features.CALENDAR]


def source_weeks(panel: DataFrame, params: Params, reads: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """``ProductID, WeekStart`` and, for each feature that reads the panel, the largest source week that it reads
    (null: none)."""
    reads = (reads or features.panel_reads(params)) | {TARGET_MEAN: TARGET_MEAN_READS}
    order = Window.partitionBy("ProductID").orderBy("WeekStart")
    source = lambda frame: F.max("_source").over(order.rowsBetween(*frame))
    df = panel.select("ProductID", "WeekStart", F.col("WeekStart").alias("_source"))
    # features of one frame have one source
    frames = list(dict.fromkeys(reads.values()))
    df = df.select("*", *[source(f).alias(f"_f{i}") for i, f in enumerate(frames)])
    direct = {c: F.col(f"_f{frames.index(f)}") for c, f in reads.items()}
    previous = {f"{c}_prev": F.lag(direct[c], features.PREVIOUS).over(order) for c in (*features.RUNNING, *features.SAME_WEEK)}
    return df.select("ProductID", "WeekStart", *[x.alias(c) for c, x in (direct | previous).items()])


def leakage_violations(flow, reads: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """(ProductID, WeekStart, column) for every model input that reads its own week or a later one."""
    return panel_violations(flow.panel_base, flow.params, reads)


def panel_violations(panel: DataFrame, params: Params, reads: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    sources = source_weeks(panel, params, reads)
    checked = [c for c in [*model_input_columns(params), TARGET_MEAN] if c in sources.columns]
    leaks: Column = F.array(*[F.when(F.col(c) >= F.col("WeekStart"), F.lit(c)) for c in checked])
    return sources.select("ProductID", "WeekStart", F.explode(F.array_compact(leaks)).alias("column"))
