"""Stage 5 — gap-free product panel and engineered features.

Physical design: the weekly table is clustered once by ProductID; the
densification (``lead`` + ``sequence``), the product-level modes, the lags,
the rolling windows and the zero-run features are all windows over that one
clustering, so the whole stage costs a single hash exchange. Densification is
output-sized: each weekly row expands to itself plus the empty weeks before
the product's next observation (or the global last week), so there is no
product x week cartesian grid and no join. A product's panel is bounded by
the number of weeks in the history, so a hot product cannot grow a task
beyond that.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CATEGORICAL_MODE_COLUMNS, Params
from ..functions.columns import mode_lowest, safe_div, week_of_month



def _by_product():
    # whole-series frame, ordered like the other windows so they share one sort
    return (Window.partitionBy("ProductID").orderBy("WeekStart")
            .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def _w():
    return Window.partitionBy("ProductID").orderBy("WeekStart")


PANEL_COLUMNS = (
    "ProductID", "WeekStart", "Sales_Qty", "Sales_USD", "returns_exceeded_sales",
    "transaction_count", *CATEGORICAL_MODE_COLUMNS,
)


def lag_name(k: int) -> str:
    return f"Sales_Qty_lag_{k}"


def featured_columns(params: Params) -> tuple[str, ...]:
    roll = []
    for w in params.windows:
        roll += [f"Sales_Qty_rollmean_{w}", f"Sales_Qty_rollstd_{w}"]
    return (*PANEL_COLUMNS, *[lag_name(k) for k in params.lags], *roll,
            "dominant_dow", "pct_weekend_orders", "month", "week_of_month", "quarter",
            "week_of_year", "is_year_end", "is_lk_holiday_week", "zero_streak_length",
            "cumulative_zero_weeks", "unit_price")


def product_modes(weekly_df: DataFrame, as_of: _dt.date | None = None) -> DataFrame:
    """Static attributes: mode of the weekly modes per product (one vote per week)."""
    def src(c: str) -> Column:
        return F.col(c) if as_of is None else F.when(F.col("WeekStart") <= F.lit(as_of), F.col(c))
    return weekly_df.groupBy("ProductID").agg(
        *[mode_lowest(src(c)).alias(c) for c in CATEGORICAL_MODE_COLUMNS])


def dense_panel(weekly_ext: DataFrame, last_week: _dt.date,
                as_of: _dt.date | None = None, with_modes: bool = True) -> DataFrame:
    """Each product from its own first week to ``last_week``, gaps filled with 0.

    Keeps the day-of-week columns when present (null / 0.0 in filled weeks).
    Categoricals are the product-level modes; with ``with_modes=False`` they are
    left out so the caller can attach them after the row-heavy windows
    (``attach_modes``) instead of carrying five strings through the sort.
    """
    has_dow = "dominant_dow" in weekly_ext.columns
    nxt = F.lead("WeekStart").over(_w())
    end = F.coalesce(F.date_sub(nxt, 7), F.lit(last_week))
    x = weekly_ext.where(F.col("WeekStart") <= F.lit(last_week))
    x = x.select(
        "ProductID", "WeekStart", "Sales_Qty", "Sales_USD", "returns_exceeded_sales",
        "transaction_count",
        *([F.col("dominant_dow"), F.col("pct_weekend_orders")] if has_dow else []),
        F.floor(F.datediff(end, F.col("WeekStart")) / 7).cast("int").alias("_gap"),
    )
    # whole numbers, not dates: a sequence of dates is worked out in time stamps and zones, week by week
    x = x.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.col("_gap"), F.lit(0)))).alias("_pos"))
    first = F.col("_pos") == 0
    out = [
        "ProductID",
        F.date_add("WeekStart", F.col("_pos") * 7).alias("WeekStart"),
        F.when(first, F.col("Sales_Qty")).otherwise(F.lit(0.0)).alias("Sales_Qty"),
        F.when(first, F.col("Sales_USD")).otherwise(F.lit(0.0)).alias("Sales_USD"),
        F.when(first, F.col("returns_exceeded_sales")).otherwise(F.lit(False))
        .alias("returns_exceeded_sales"),
        F.when(first, F.col("transaction_count")).otherwise(F.lit(0)).cast("long")
        .alias("transaction_count"),
    ]
    if has_dow:
        out += [F.when(first, F.col("dominant_dow")).alias("dominant_dow"),
                F.when(first, F.col("pct_weekend_orders")).otherwise(F.lit(0.0))
                .alias("pct_weekend_orders")]
    panel = x.select(*out)
    if with_modes:
        panel = attach_modes(panel, weekly_ext, last_week, as_of)
    return panel


def attach_modes(df: DataFrame, weekly_ext: DataFrame, last_week: _dt.date,
                 as_of: _dt.date | None = None) -> DataFrame:
    """Join the product-level modes (one row per product). The panel side is
    already clustered and sorted by ProductID, so only the small mode table
    moves."""
    modes = product_modes(weekly_ext.where(F.col("WeekStart") <= F.lit(last_week)), as_of)
    return df.join(modes, "ProductID", "left")


def holiday_weeks(holidays: DataFrame) -> DataFrame:
    """Distinct Mondays of weeks containing a holiday (column ``day`` is a date)."""
    return (holidays.select(F.date_trunc("week", F.col("day")).cast("date").alias("WeekStart"))
            .distinct())


PREVIOUS = 1  # rows that last week's copies of same-week features look back
SAME_WEEK = ("dominant_dow", "pct_weekend_orders", "unit_price")
RUNNING = ("zero_streak_length", "cumulative_zero_weeks")
CALENDAR = ("month", "week_of_month", "quarter", "week_of_year", "is_year_end", "is_lk_holiday_week")


def panel_reads(params: Params) -> dict[str, tuple[int, int]]:
    """Rows of its product that each feature reads, as offsets (first, last) to its own row. The features are
    computed from this table, and the leakage guard follows it."""
    start = Window.unboundedPreceding
    reads = {lag_name(k): (-k, -k) for k in params.lags}
    for w in params.windows:
        reads[f"Sales_Qty_rollmean_{w}"] = reads[f"Sales_Qty_rollstd_{w}"] = (-w, -1)
    return reads | dict.fromkeys(RUNNING, (start, 0)) | dict.fromkeys(SAME_WEEK, (0, 0))


def add_features(panel: DataFrame, hol_weeks: DataFrame, params: Params,
                 model_lags: bool = False, reads: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Lags, rolling stats (previous rows only), calendar, holiday week, zero
    runs and unit price — the published feature set. With ``model_lags`` the
    frame also carries last week's same-week features (``*_prev``) used as
    leak-free model inputs."""
    q = F.col("Sales_Qty")
    reads = reads or panel_reads(params)
    frame = lambda name: _w().rowsBetween(*reads[name])
    cols: list[Column | str] = list(panel.columns)
    for k in params.lags:
        cols.append(F.lag(q, -reads[lag_name(k)][1]).over(_w()).alias(lag_name(k)))
    for w in params.windows:
        for name, stat in ((f"Sales_Qty_rollmean_{w}", F.avg), (f"Sales_Qty_rollstd_{w}", F.stddev_samp)):
            cols.append(stat(q).over(frame(name)).alias(name))
    last_nonzero = F.max(F.when(q != 0, F.col("WeekStart"))).over(frame("zero_streak_length"))
    first_week = F.min("WeekStart").over(frame("zero_streak_length"))
    streak = F.when(last_nonzero.isNull(),
                    F.datediff(F.col("WeekStart"), first_week) / 7 + 1) \
        .otherwise(F.datediff(F.col("WeekStart"), last_nonzero) / 7)
    cols += [
        streak.cast("long").alias("zero_streak_length"),
        F.sum((q == 0).cast("long")).over(frame("cumulative_zero_weeks")).alias("cumulative_zero_weeks"),
    ]
    df = panel.select(*cols)
    if "dominant_dow" not in df.columns:
        df = df.withColumn("dominant_dow", F.lit(None).cast("double")) \
               .withColumn("pct_weekend_orders", F.lit(0.0))
    wk = F.col("WeekStart")
    hw = hol_weeks.select("WeekStart", F.lit(True).alias("_hol"))
    df = df.join(hw, "WeekStart", "left")
    df = df.select(
        "*",
        F.month(wk).cast("long").alias("month"),
        week_of_month(wk).cast("long").alias("week_of_month"),
        F.quarter(wk).cast("long").alias("quarter"),
        F.weekofyear(wk).cast("long").alias("week_of_year"),
        F.month(wk).isin(11, 12).alias("is_year_end"),
        F.coalesce(F.col("_hol"), F.lit(False)).alias("is_lk_holiday_week"),
        F.when(q > 0, safe_div(F.col("Sales_USD"), q)).alias("unit_price"),
    ).drop("_hol")
    if model_lags:
        df = df.select("*", *[F.lag(c, PREVIOUS).over(_w()).alias(f"{c}_prev") for c in (*RUNNING, *SAME_WEEK)])
    return df


def feature_audit(featured: DataFrame) -> DataFrame:
    return featured.agg(
        F.count(F.lit(1)).alias("featured_rows"),
        F.countDistinct("ProductID").alias("products"),
        F.countDistinct("WeekStart").alias("weeks"),
        F.avg((F.col("Sales_Qty") == 0).cast("double")).alias("zero_sales_share"),
    )
