"""Metrics, backtest tables and the baseline check.

RMSE, MAE and WMAPE are plain aggregates; MASE scales each series' MAE by the
mean absolute seasonal difference of its own training history (``lag`` over
the series, then a grouped mean), so both levels are shuffles on the series
key and nothing is gathered per series.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import HV_BASELINES, SPARSE_BASELINES
from ..functions.columns import mae, rmse, wmape

COMPARISON_COLUMNS = ("tier", "model", "is_baseline", "rmse", "mae", "wmape", "mase",
                      "train_seconds", "inference_seconds")


def metric_table(pred: DataFrame, y: str, p: str, by=("model",)) -> DataFrame:
    return pred.where(F.col(y).isNotNull()).groupBy(*by).agg(
        rmse(F.col(y), F.col(p)).alias("rmse"), mae(F.col(y), F.col(p)).alias("mae"),
        wmape(F.col(y), F.col(p)).alias("wmape"), F.count(F.lit(1)).alias("n"))


def history_scale(history: DataFrame, season: int = 1, id_col: str = "unique_id",
                  t_col: str = "ds", y_col: str = "y") -> DataFrame:
    """Per series: mean |y_t - y_{t-s}| over its history (0 when too short)."""
    w = Window.partitionBy(id_col).orderBy(t_col)
    d = history.select(id_col, F.abs(F.col(y_col) - F.lag(y_col, season).over(w)).alias("_d"))
    return d.groupBy(id_col).agg(F.coalesce(F.avg("_d"), F.lit(0.0)).alias("scale"))


def mase_per_series(valid: DataFrame, history: DataFrame, season: int = 1) -> DataFrame:
    """(unique_id, model, mase): scored rows only; a zero scale falls back to
    the plain MAE (0 when the forecast is perfect)."""
    scored = valid.where(F.col("y").isNotNull())
    num = scored.groupBy("unique_id", "model").agg(mae(F.col("y"), F.col("y_pred")).alias("num"))
    sc = history_scale(history, season)
    j = num.join(sc, "unique_id", "left").withColumn("scale", F.coalesce("scale", F.lit(0.0)))
    return j.select("unique_id", "model",
                    F.when(F.col("scale") == 0, F.col("num"))
                    .otherwise(F.col("num") / F.col("scale")).alias("mase"))


def score_sparse(valid: DataFrame, history: DataFrame, season: int = 1) -> DataFrame:
    """Per model: pooled WMAPE over rows with actuals, mean of per-series MASE."""
    scored = valid.where(F.col("y").isNotNull())
    w = scored.groupBy("model").agg(wmape(F.col("y"), F.col("y_pred")).alias("wmape"))
    m = mase_per_series(valid, history, season).groupBy("model").agg(
        F.avg("mase").alias("mase"))
    return (w.join(m, "model", "left")
            .select(F.lit("sparse").alias("tier"), "model",
                    F.col("model").isin(*SPARSE_BASELINES).alias("is_baseline"),
                    "wmape", F.coalesce("mase", F.lit(0.0)).alias("mase")))


def score_high_volume(valid: DataFrame) -> DataFrame:
    return (valid.groupBy("model")
            .agg(rmse(F.col("y_true"), F.col("y_pred")).alias("rmse"),
                 mae(F.col("y_true"), F.col("y_pred")).alias("mae"))
            .select(F.lit("high_volume").alias("tier"), "model",
                    F.col("model").isin(*HV_BASELINES).alias("is_baseline"), "rmse", "mae"))


def with_timings(table: DataFrame, timings: DataFrame) -> DataFrame:
    """Joins (model, train_seconds, inference_seconds); baselines train in 0 s."""
    j = table.join(F.broadcast(timings), "model", "left")
    return j.withColumn("train_seconds", F.coalesce("train_seconds", F.lit(0.0)))


def model_comparison(hv: DataFrame, sparse: DataFrame) -> DataFrame:
    out = hv.unionByName(sparse, allowMissingColumns=True)
    return out.select(*[F.col(c) if c in out.columns else F.lit(None).cast("double").alias(c)
                        for c in COMPARISON_COLUMNS])


def baseline_check(comparison: DataFrame, tier: str, metric: str) -> DataFrame:
    """Baseline value vs the best challenger (arg-min, ties by model name)."""
    t = comparison.where(F.col("tier") == tier)
    return t.agg(
        F.min(F.when(F.col("is_baseline"), F.col(metric))).alias("baseline_value"),
        F.min(F.when(F.col("is_baseline"), F.col("model"))).alias("baseline_model"),
        F.min_by(F.when(~F.col("is_baseline"), F.col("model")),
                 F.when(~F.col("is_baseline"), F.struct(F.col(metric), F.col("model"))))
        .alias("best_model"),
        F.min(F.when(~F.col("is_baseline"), F.col(metric))).alias("best_value"),
    ).select(F.lit(tier).alias("tier"), F.lit(metric).alias("metric"), "baseline_model",
             "baseline_value", "best_model", "best_value",
             (F.col("best_value") < F.col("baseline_value")).alias("beats_baseline"))


def train_history(long_df: DataFrame, cutoff: _dt.date) -> DataFrame:
    return long_df.where(F.col("ds") <= F.lit(cutoff))
