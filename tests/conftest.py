from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

WEEK0 = dt.date(2022, 2, 28)  # a Monday


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from hebdocast.session import ensure_checkpoint_dir, tune_session
    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    tune_session(s)
    ensure_checkpoint_dir(s)
    yield s


def weeks(n: int, start: dt.date = WEEK0) -> list[dt.date]:
    return [start + dt.timedelta(days=7 * i) for i in range(n)]


def make_weekly(spark, rows):
    """Weekly-schema frame from (ProductID, WeekStart, Sales_Qty) with the
    defaults of the published fixtures."""
    full = []
    for pid, wk, q in rows:
        full.append((pid, wk, float(q), float(q), False, int(q > 0), "Europe", "Germany", "Retail",
                     "Retail", "PREMIUM GRADE", None, 0.0))
    return spark.createDataFrame(full, (
        "ProductID string, WeekStart date, Sales_Qty double, Sales_USD double, "
        "returns_exceeded_sales boolean, transaction_count long, Region string, Country string, "
        "`Sales Channel` string, `Brand Category` string, `Product Range` string, "
        "dominant_dow double, pct_weekend_orders double"))


def featured_of(spark, weekly, params=None):
    from hebdocast.config import Params
    from hebdocast.operators import features
    from hebdocast.sources import calendar
    p = params or Params()
    last = weekly.agg({"WeekStart": "max"}).first()[0]
    first = weekly.agg({"WeekStart": "min"}).first()[0]
    hol = features.holiday_weeks(calendar.holiday_dim(spark, first.year, last.year + 2,
                                                      p.holiday_month_days))
    panel = features.dense_panel(weekly, last)
    return features.add_features(panel, hol, p, model_lags=True)
