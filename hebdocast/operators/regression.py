"""High-volume tier: seasonal-naive baseline and global boosted trees (see ``boosting``).

Everything before the fit is DataFrame work on the ProductID clustering of the
featured panel. The recursive 12-week forecast keeps one row per product as
state (its last inputs and a history array) and does all its steps in one pass:
each step derives the lag and rolling inputs from the history, scores with the fitted
model and appends the clipped prediction.
"""

from __future__ import annotations

import dataclasses
import datetime as _dt
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import (CATEGORICAL_MODE_COLUMNS, GBT, GBT_DEEP, HIGH_VOLUME, MODEL_CATEGORICAL_COLUMNS,
                      SEASONAL_NAIVE, Params)
from ..functions.columns import week_of_month
from ..functions.quantiles import rank_within_key
from . import boosting, panels
from .features import lag_name
from .tiers import rows_of
from .leakage import TARGET_MEAN, TARGET_MEAN_READS, model_input_columns

SEASON = 12  # weeks of the seasonal-naive season
BOOL_COLUMNS = ("is_year_end", "is_lk_holiday_week", "returns_exceeded_sales")


def _w():
    return Window.partitionBy("ProductID").orderBy("WeekStart")


def hv_frame(featured: DataFrame, tiers: DataFrame | None = None) -> DataFrame:
    """Featured rows of high-volume products; booleans as 0/1, dow as double, and the
    product's mean quantity over the weeks before each row (its target encoding). Without ``tiers``,
    ``featured`` holds only those products."""
    df = featured if tiers is None else rows_of(featured, tiers, HIGH_VOLUME)
    earlier = _w().rowsBetween(*TARGET_MEAN_READS)
    df = df.withColumn(TARGET_MEAN, F.avg("Sales_Qty").over(earlier))
    for c in BOOL_COLUMNS:
        if c in df.columns:
            df = df.withColumn(c, F.col(c).cast("long"))
    return df.withColumn("dominant_dow", F.col("dominant_dow").cast("double"))


# --- category dictionary -----------------------------------------------------
def category_dictionary(df: DataFrame, columns=MODEL_CATEGORICAL_COLUMNS) -> DataFrame:
    """(column_name, value, code): sorted distinct non-null values, code from 0.

    One job covers every column: values are unpivoted, made distinct and ranked
    by a range-partitioned sort, so a column with millions of values (ProductID)
    is never ordered inside one task.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v"))
                      for c in columns])
    long = (df.select(F.explode(pairs).alias("p")).select("p.k", "p.v")
            .where(F.col("v").isNotNull()).distinct())
    return (rank_within_key(long, "k", "v")
            .select(F.col("k").alias("column_name"), F.col("v").alias("value"),
                    F.col("rank").cast("long").alias("code")))


def extended_dictionary(former: DataFrame, df: DataFrame, columns=MODEL_CATEGORICAL_COLUMNS) -> DataFrame:
    """``former`` with its codes as they are, and the values of ``df`` that it lacks behind them: sorted, from the
    column's next code on. New values are ranked by a range-partitioned sort, whatever their number."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    seen = df.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("value").isNotNull()).distinct()
    new = rank_within_key(seen.join(former, ["column_name", "value"], "left_anti"), "column_name", "value")
    ends = former.groupBy("column_name").agg((F.max("code") + 1).alias("_from"))  # a row a column
    new = new.join(ends, "column_name", "left").select(
        "column_name", "value", (F.col("rank") + F.coalesce("_from", F.lit(0))).cast("long").alias("code"))
    return former.select("column_name", "value", "code").unionByName(new)


def apply_dictionary(df: DataFrame, dictionary: DataFrame,
                     columns=MODEL_CATEGORICAL_COLUMNS) -> DataFrame:
    """Adds ``<col>_code``; values missing from the dictionary get null. How each slice of the
    dictionary is joined is the planner's choice, by its measured bytes."""
    out = df
    for c in columns:
        d = dictionary.where(F.col("column_name") == c).select(
            F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"{c}_code"))
        out = out.join(d, out[c].cast("string") == d[f"_v_{c}"], "left").drop(f"_v_{c}")
    return out


# --- split and baseline ----------------------------------------------------------
def split(df: DataFrame, cut) -> tuple[DataFrame, DataFrame]:
    train = df.where(F.col("WeekStart") <= F.lit(cut.train_end))
    valid = df.where((F.col("WeekStart") >= F.lit(cut.valid_start))
                     & (F.col("WeekStart") <= F.lit(cut.valid_end)))
    return train, valid


def seasonal_naive_valid(valid: DataFrame) -> DataFrame:
    """lag 12, else lag 1, else 0 (one-step, from the precomputed lags)."""
    pred = F.coalesce(F.col(lag_name(12)), F.col(lag_name(1)), F.lit(0.0))
    return valid.select("ProductID", "WeekStart", F.col("Sales_Qty").alias("y_true"),
                        F.lit(SEASONAL_NAIVE).alias("model"), pred.alias("y_pred"))


# --- boosted trees -----------------------------------------------------------------
def numeric_inputs(params: Params) -> list[str]:
    """Numeric model inputs (the product enters as its mean over earlier weeks)."""
    return [c for c in model_input_columns(params) if c not in CATEGORICAL_MODE_COLUMNS] + [TARGET_MEAN]


def feature_names(params: Params) -> list[str]:
    return numeric_inputs(params) + list(CATEGORICAL_MODE_COLUMNS)


def category_sizes(dictionary: DataFrame) -> dict[str, int]:
    """Number of codes of each categorical input (one row per column)."""
    rows = dictionary.groupBy("column_name").agg(F.max("code").alias("last")).collect()
    found = {r["column_name"]: r["last"] + 1 for r in rows}
    return {c: found.get(c, 0) for c in CATEGORICAL_MODE_COLUMNS}


def weekly_inputs(weekly: DataFrame, codes: DataFrame, last_week: _dt.date, parts: int) -> DataFrame:
    """What :mod:`panels` reads: weekly rows up to a week with the codes of their product, each product's rows in order
    in one of ``parts`` partitions."""
    rows = weekly.where(F.col("WeekStart") <= F.lit(last_week)).select("ProductID", "WeekStart", *panels.WEEKLY)
    coded = rows.join(codes, "ProductID", "left").repartition(parts, "ProductID").sortWithinPartitions("ProductID", "WeekStart")
    return coded.select("ProductID", F.datediff("WeekStart", F.lit(panels.EPOCH)).alias("day"), *panels.WEEKLY,
                        *[f"{c}_code" for c in CATEGORICAL_MODE_COLUMNS])


def _until(weekly: DataFrame, week: _dt.date) -> DataFrame:
    return weekly.where(F.col("day") <= boosting.day(week))


_CODES = tuple(f"{c}_code" for c in CATEGORICAL_MODE_COLUMNS)


def binning(weekly: DataFrame, train_end: _dt.date, params: Params, sizes: dict[str, int], holidays: Sequence[_dt.date]) -> boosting.Binning:
    """Bins of the model inputs, cut on the training weeks. ``weekly`` is that of :func:`weekly_inputs`."""
    names = numeric_inputs(params)

    def rows(batches):
        return panels.rows_of_panels(batches, names, (), params, train_end, holidays)

    return boosting.fit_binning(_until(weekly, train_end), names, sizes, params.gbt_max_bins, rows)


def matrix(weekly: DataFrame, bins: boosting.Binning, params: Params, last_week: _dt.date, holidays: Sequence[_dt.date]) -> DataFrame:
    """The stored matrix of all rows up to a week, made of :func:`weekly_inputs`."""

    def rows(batches):
        return panels.rows_of_panels(batches, bins.numeric, _CODES, params, last_week, holidays)

    return boosting.matrix(_until(weekly, last_week), bins, made=rows)


def coded_state(weekly: DataFrame, params: Params, last_week: _dt.date, holidays: Sequence[_dt.date]) -> DataFrame:
    """As :func:`recursive_state` of the model inputs, with category codes, made of :func:`weekly_inputs`."""
    names, window = numeric_inputs(params), state_window(params)
    columns = [*names, *_CODES]

    def rows(batches):
        return panels.last_rows(batches, names, _CODES, params, last_week, holidays, window)

    schema = ", ".join(["ProductID string, history array<double>", *[f"x{i} double" for i in range(len(columns))]])
    return _until(weekly, last_week).mapInArrow(rows, schema).select(
        "ProductID", "history", *[F.col(f"x{i}").alias(c) for i, c in enumerate(columns)])


def hv_rules(params: Params) -> dict[str, boosting.Rules]:
    """The two models: best-first trees of many leaves, and trees grown by level."""
    shared = dict(step=params.gbt_step, rounds=params.gbt_max_iter, min_rows=params.gbt_min_instances, patience=params.gbt_patience)
    return {GBT: boosting.Rules(leaves=params.gbt_leaves, **shared),
            GBT_DEEP: boosting.Rules(depth=params.gbt_deep_depth, l2=params.gbt_deep_l2, **shared)}


def early_stopped(params: Params, cut) -> list[boosting.Ensemble]:
    """Ensembles that fit the training weeks but the last ``horizon`` ones, on which their loss is measured. The
    scoring fold takes no part."""
    first, last = boosting.day(_dt.date(1900, 1, 1)), boosting.day(cut.train_end)
    held = last - 7 * (params.horizon - 1)
    return [boosting.Ensemble(name, rules, (first, held - 1), (held, last)) for name, rules in hv_rules(params).items()]


def with_rounds(early: list[boosting.Ensemble], last_day: _dt.date) -> list[boosting.Ensemble]:
    """Ensembles of the rounds that early stopping found best, to be fitted on all weeks up to a day."""
    first = boosting.day(_dt.date(1900, 1, 1))
    return [boosting.Ensemble(e.name, dataclasses.replace(e.rules, rounds=e.best()[0] if e.losses else 0, patience=None),
                              (first, boosting.day(last_day))) for e in early]


def predict_valid(matrix: DataFrame, ensemble: boosting.Ensemble, cut, features: int) -> DataFrame:
    days = boosting.day(cut.valid_start), boosting.day(cut.valid_end)
    return boosting.predictions(matrix, ensemble, days, features).select(
        "ProductID", "WeekStart", "y_true", F.lit(ensemble.name).alias("model"), "y_pred")


# --- recursion state ----------------------------------------------------------
def state_window(params: Params) -> int:
    """Weeks of history that the recursion needs."""
    return max(SEASON, *params.lags, *params.windows)


def recursive_state(df: DataFrame, last_week: _dt.date, window: int = SEASON) -> DataFrame:
    """Last row per product with ``history``: its last ``window`` quantities,
    oldest first, left-padded with nulls. A bounded window over the existing
    clustering; no grouping of whole series."""
    tail = F.collect_list("Sales_Qty").over(_w().rowsBetween(-(window - 1), 0))
    x = df.withColumn("_tail", tail)
    if TARGET_MEAN in df.columns:  # the coming week looks back on all observed weeks
        x = x.withColumn(TARGET_MEAN, F.avg("Sales_Qty").over(_w().rowsBetween(Window.unboundedPreceding, 0)))
    x = x.where(F.col("WeekStart") == F.lit(last_week))
    pad = F.array_repeat(F.lit(None).cast("double"), F.lit(window) - F.size("_tail"))
    x = x.withColumn("history", F.concat(pad, F.col("_tail"))).drop("_tail")
    # for the week after the last one, "last week's" same-week values are the
    # last observed row's own values; they stay frozen over the horizon
    prev = {c[:-5]: c for c in x.columns if c.endswith("_prev") and c[:-5] in x.columns}
    return x.withColumns({p: F.col(c) for c, p in prev.items()})


def _nn(arr: Column) -> Column:
    return F.filter(arr, lambda v: v.isNotNull())


def _mean(arr: Column) -> Column:
    vals = _nn(arr)
    s = F.aggregate(vals, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(vals) > 0, s / F.size(vals))


def _std(arr: Column) -> Column:
    vals = _nn(arr)
    m = _mean(arr)
    ss = F.aggregate(vals, F.lit(0.0), lambda acc, v: acc + (v - m) * (v - m))
    return F.when(F.size(vals) >= 2, F.sqrt(ss / (F.size(vals) - 1)))


def step_features(state: DataFrame, week: _dt.date, hol_weeks: list[_dt.date],
                  params: Params) -> DataFrame:
    """Lag/rolling inputs of ``week`` from the history array, its calendar and
    holiday flags; every other input stays at the product's last value."""
    h, window = F.col("history"), state_window(params)
    cols = {lag_name(k): F.element_at(h, window - k + 1) for k in params.lags}
    for w in params.windows:
        part = F.slice(h, window - w + 1, w)
        cols[f"Sales_Qty_rollmean_{w}"] = _mean(part)
        cols[f"Sales_Qty_rollstd_{w}"] = _std(part)
    wk = F.lit(week)
    cols.update({
        "WeekStart": wk,
        "month": F.month(wk).cast("long"),
        "week_of_month": week_of_month(wk).cast("long"),
        "quarter": F.quarter(wk).cast("long"),
        "week_of_year": F.weekofyear(wk).cast("long"),
        "is_year_end": F.lit(int(week.month in (11, 12))).cast("long"),
        "is_lk_holiday_week": F.lit(int(week in set(hol_weeks))).cast("long"),
    })
    return state.withColumns(cols)


def step_inputs(history: np.ndarray, last: dict[str, np.ndarray], week: _dt.date, holiday: bool,
                params: Params) -> dict[str, np.ndarray]:
    """As :func:`step_features`, over arrays: ``history`` is products x weeks (NaN: unknown)."""
    n = len(history)
    out = dict(last)
    for k in params.lags:
        out[lag_name(k)] = history[:, -k]
    for w in params.windows:
        part = history[:, -w:]
        known = ~np.isnan(part)
        count = known.sum(1)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.where(known, part, 0.0).sum(1) / count
            ss = np.where(known, (part - mean[:, None]) ** 2, 0.0).sum(1)
            out[f"Sales_Qty_rollmean_{w}"] = np.where(count > 0, mean, np.nan)
            out[f"Sales_Qty_rollstd_{w}"] = np.where(count >= 2, np.sqrt(ss / (count - 1)), np.nan)
    calendar = {"month": week.month, "week_of_month": (week.day - 1) // 7 + 1, "quarter": (week.month + 2) // 3,
                "week_of_year": week.isocalendar()[1], "is_year_end": int(week.month in (11, 12)), "is_lk_holiday_week": int(holiday)}
    return out | {c: np.full(n, float(v)) for c, v in calendar.items()}


def recursive_forecast(ensemble: boosting.Ensemble, bins: boosting.Binning, state: DataFrame, params: Params,
                       origin: _dt.date, hol_weeks: list[_dt.date], steps: int | None = None) -> DataFrame:
    """Predict, clip at 0, append to history, repeat: all steps of a product in one pass over the state
    table, on arrays of many products, with the trees as flat arrays in the task."""
    window, steps = state_window(params), steps or params.horizon
    weeks = [origin + _dt.timedelta(days=7 * k) for k in range(steps)]
    holidays = set(hol_weeks)
    inputs = [F.col(f"`{c}`").cast("double").alias(f"x{i}") if c in state.columns else F.lit(None).cast("double").alias(f"x{i}")
              for i, c in enumerate([*bins.numeric, *[f"{c}_code" for c in bins.nominal]])]

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            history = batch.column("history").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, window)
            last = {c: batch.column(f"x{i}").to_numpy(zero_copy_only=False).astype(np.float64) for i, c in enumerate(bins.names)}
            out = np.empty((n, steps))
            for k, week in enumerate(weeks):
                x = step_inputs(history, last, week, week in holidays, params)
                out[:, k] = np.maximum(ensemble.predict(bins.apply([x[c] for c in bins.names])), 0.0)
                history = np.concatenate([history[:, 1:], out[:, k:k + 1]], 1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * steps, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("ProductID"), lists], names=["ProductID", "preds"])

    rows = state.select(F.col("ProductID").cast("string"), "history", *inputs).mapInArrow(run, "ProductID string, preds array<double>")
    return rows.select("ProductID", F.posexplode("preds").alias("_i", "predicted_Sales_Qty")).select(
        "ProductID", (F.col("_i") + 1).cast("long").alias("forecast_week"),
        F.date_add(F.lit(origin), (F.col("_i") * 7).cast("int")).alias("WeekStart"),
        "predicted_Sales_Qty", F.lit(ensemble.name).alias("model"))


def seasonal_naive_forecast(state: DataFrame, origin: _dt.date, horizon: int) -> DataFrame:
    """Week h takes the value of the same place in the last season of 12 weeks (repeated beyond one
    season), else the last value, else 0, clipped at 0."""
    season = F.slice("history", F.size("history") - SEASON + 1, SEASON)
    steps = F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)),
                        lambda i: F.element_at(season, (i % SEASON + 1).cast("int")))
    x = state.select("ProductID", F.element_at("history", -1).alias("_last"), F.posexplode(steps).alias("_i", "_v"))
    pred = F.greatest(F.coalesce(F.col("_v"), F.col("_last"), F.lit(0.0)), F.lit(0.0))
    return x.select("ProductID", (F.col("_i") + 1).cast("long").alias("forecast_week"),
                    F.date_add(F.lit(origin), (F.col("_i") * 7).cast("int")).alias("WeekStart"),
                    pred.alias("predicted_Sales_Qty"), F.lit(SEASONAL_NAIVE).alias("model"))


def forecast_violations(fc: DataFrame, ids: DataFrame, horizon: int,
                        models: Sequence[str] = (SEASONAL_NAIVE, GBT, GBT_DEEP)) -> DataFrame:
    """Products x models without exactly ``horizon`` rows (none at all included), and negative values."""
    counts = fc.groupBy("ProductID", "model").agg(F.count(F.lit(1)).alias("rows"))
    wanted = ids.select("ProductID").distinct().select(
        "ProductID", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    per = (wanted.join(counts, ["ProductID", "model"], "left")
           .where(F.coalesce(F.col("rows"), F.lit(0)) != horizon)
           .select("ProductID", "model", F.lit("horizon").alias("violation")))
    neg = (fc.where(F.col("predicted_Sales_Qty") < 0)
           .select("ProductID", "model", F.lit("negative").alias("violation")))
    return per.unionByName(neg)
