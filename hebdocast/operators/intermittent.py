"""Intermittent-demand forecasts for the sparse tier (Croston, SBA, TSB, Naive).

Simple exponential smoothing whose level starts at the first value ends at a
closed-form weighted sum, ``level = sum_i w_i x_i`` with
``w_1 = (1-a)^(m-1)`` and ``w_i = a(1-a)^(m-i)``. Every method is therefore a
per-series aggregate over ranked rows — windows on one clustering by series
and a grouped sum — with no Python in the plan and no per-series loop.

Pinned contract: demand sizes are the non-zero values; intervals count
weeks from the series start for the first demand (1-based) and between
consecutive demands after that; Croston = size level / interval level (size
level when the interval level is 0); SBA = 0.95 x Croston; TSB = occurrence
level (over every week) x size level; an all-zero series forecasts 0; a
series with fewer than ``min_fit_rows`` rows repeats its last value (0 if
none).
"""

from __future__ import annotations

import datetime as _dt

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CROSTON, NAIVE, SBA, SPARSE, TSB, Params
from ..functions.columns import ses_weight
from .tiers import rows_of



def _s():
    return Window.partitionBy("unique_id").orderBy("ds")


def _whole():
    return Window.partitionBy("unique_id")


def sparse_long(featured: DataFrame, tiers: DataFrame | None = None, tier: str = SPARSE) -> DataFrame:
    """``unique_id, ds, y`` rows of the tier's products. Without ``tiers``, ``featured`` holds only those."""
    rows = featured if tiers is None else rows_of(featured, tiers, tier)
    return (rows.select(F.col("ProductID").alias("unique_id"), F.col("WeekStart").alias("ds"),
                    F.col("Sales_Qty").alias("y")))


def train_rows(long_df: DataFrame, cutoff: _dt.date) -> DataFrame:
    return long_df.where(F.col("ds") <= F.lit(cutoff))


def actual_rows(long_df: DataFrame, start: _dt.date, end: _dt.date) -> DataFrame:
    return long_df.where((F.col("ds") >= F.lit(start)) & (F.col("ds") <= F.lit(end)))


def series_levels(train: DataFrame, params: Params) -> DataFrame:
    """One row per series: row count, last value and the four model values."""
    nz = F.col("y") != 0
    ranked = train.select(
        "unique_id", "ds", "y",
        F.row_number().over(_s()).alias("pos"),
        F.sum(nz.cast("long")).over(_s().rowsBetween(Window.unboundedPreceding, 0)).alias("k"),
        F.sum(nz.cast("long")).over(_whole()).alias("m"),
        F.count(F.lit(1)).over(_whole()).alias("n"),
    )
    ranked = ranked.withColumn(
        "interval",
        F.when(nz, F.col("pos") - F.coalesce(
            F.max(F.when(nz, F.col("pos"))).over(_s().rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0))))
    k, m, n, pos = F.col("k"), F.col("m"), F.col("n"), F.col("pos")
    y = F.col("y")
    w_c = ses_weight(params.croston_alpha, k, m)
    w_d = ses_weight(params.tsb_alpha_d, k, m)
    w_p = ses_weight(params.tsb_alpha_p, pos, n)
    agg = ranked.groupBy("unique_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by("y", "ds").alias("last_y"),
        F.sum(nz.cast("long")).alias("m"),
        F.sum(F.when(nz, w_c * y)).alias("size_level"),
        F.sum(F.when(nz, w_c * F.col("interval"))).alias("interval_level"),
        F.sum(F.when(nz, w_d * y)).alias("tsb_size_level"),
        F.sum(w_p * nz.cast("double")).alias("tsb_prob_level"),
    )
    croston = (F.when(F.col("m") == 0, F.lit(0.0))
               .when(F.col("interval_level") != 0, F.col("size_level") / F.col("interval_level"))
               .otherwise(F.col("size_level")))
    tsb = F.when(F.col("m") == 0, F.lit(0.0)).otherwise(
        F.col("tsb_prob_level") * F.col("tsb_size_level"))
    return agg.select(
        "unique_id", "n", "last_y",
        croston.alias(CROSTON),
        (F.lit(params.sba_factor) * croston).alias(SBA),
        tsb.alias(TSB),
        F.col("last_y").alias(NAIVE),
    )


def forecast_wide(ids: DataFrame, train: DataFrame, params: Params) -> DataFrame:
    """One row per id with the four model values, fallback applied: ids with
    fewer than ``min_fit_rows`` training rows repeat their last value (0 if
    none or null) for every model."""
    lv = series_levels(train, params)
    j = ids.select(F.col("ProductID").alias("unique_id")).join(lv, "unique_id", "left")
    fallback = F.coalesce(F.col("last_y"), F.lit(0.0))
    fit = F.coalesce(F.col("n"), F.lit(0)) >= params.min_fit_rows
    return j.select("unique_id", *[
        F.when(fit, F.col(mdl)).otherwise(fallback).cast("double").alias(mdl)
        for mdl in (CROSTON, SBA, TSB, NAIVE)])


def to_long(wide: DataFrame, start: _dt.date, horizon: int, keep: Sequence[str] = ()) -> DataFrame:
    """Wide model values -> ``unique_id, ds, model, y_pred`` (and columns to keep) over the horizon.

    The horizon is generated per row (``posexplode``), never by a join."""
    models = F.array(*[F.struct(F.lit(mdl).alias("model"), F.col(mdl).alias("y_pred"))
                       for mdl in (CROSTON, SBA, TSB, NAIVE)])
    weeks = F.sequence(F.lit(start), F.date_add(F.lit(start), 7 * (horizon - 1)),
                       F.expr("INTERVAL 7 DAYS"))
    return (wide.select("unique_id", *keep, F.explode(models).alias("mv")).select("*", F.explode(weeks).alias("ds"))
            .select("unique_id", "ds", "mv.model", "mv.y_pred", *keep))


def wide_model_frame(wide: DataFrame) -> DataFrame:
    """Melt through DataFrame.unpivot (model per row), one row per id x model."""
    return wide.unpivot("unique_id", [CROSTON, SBA, TSB, NAIVE], "model", "y_pred")


def validation_fold(long_df: DataFrame, ids: DataFrame, params: Params, cut) -> DataFrame:
    """Forecasts from training weeks <= train_end, left-joined to actuals of the
    following ``horizon`` weeks (null actual when the product had not launched).

    A series' actuals (``horizon`` values) meet its model values as one row, on the clustering by series, before
    both are spread over the weeks: no exchange by week, and no row of the panel moves."""
    wide = forecast_wide(ids, train_rows(long_df, cut.train_end), params)
    act = actual_rows(long_df, cut.valid_start, cut.valid_end).groupBy("unique_id").agg(
        F.collect_list(F.struct("ds", "y")).alias("_act"))
    preds = to_long(wide.join(act, "unique_id", "left"), cut.valid_start, params.horizon, keep=("_act",))
    y = F.transform(F.filter("_act", lambda a: a["ds"] == F.col("ds")), lambda a: a["y"])
    return preds.select("unique_id", "ds", "model", "y_pred", F.explode_outer(y).alias("y"))


def final_forecast(long_df: DataFrame, ids: DataFrame, params: Params, cut) -> DataFrame:
    return to_long(forecast_wide(ids, train_rows(long_df, cut.valid_end), params),
                   cut.origin, params.horizon)


def horizon_violations(fc: DataFrame, horizon: int, ids: DataFrame,
                       models: Sequence[str] = (CROSTON, SBA, TSB, NAIVE)) -> DataFrame:
    """Ids x models without exactly ``horizon`` rows; an id or model without any row has 0."""
    counts = fc.groupBy("unique_id", "model").agg(F.count(F.lit(1)).alias("rows"))
    wanted = ids.select(F.col(ids.columns[0]).alias("unique_id")).distinct().select(
        "unique_id", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    return (wanted.join(counts, ["unique_id", "model"], "left")
            .withColumn("rows", F.coalesce("rows", F.lit(0).cast("bigint"))).where(F.col("rows") != horizon))


def keep_last(fc: DataFrame, priority: str) -> DataFrame:
    """One row per (unique_id, ds, model): that of the highest ``priority``, the column that tells
    later rows (fallback over library) from earlier ones; equal priorities keep the lower value."""
    w = Window.partitionBy("unique_id", "ds", "model").orderBy(F.col(priority).desc(), F.col("y_pred"))
    return fc.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn", priority)
