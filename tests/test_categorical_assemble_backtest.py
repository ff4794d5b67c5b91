import datetime as dt

from pyspark.sql import functions as F

from hebdocast.operators import assemble, regression, scoring


def test_dictionary_sorted_and_unseen_is_null(spark):
    df = spark.createDataFrame([("C", "x"), ("A", "y"), ("B", None)], "Region string, ProductID string")
    d = regression.category_dictionary(df, ("Region",))
    assert [(r["value"], r["code"]) for r in d.orderBy("code").collect()] == [("A", 0), ("B", 1), ("C", 2)]
    later = spark.createDataFrame([("A",), ("D",)], "Region string")
    enc = regression.apply_dictionary(later, d, ("Region",)).orderBy("Region").collect()
    assert [r["Region_code"] for r in enc] == [0, None]


def _fc(spark, rows):
    return spark.createDataFrame(rows, "ProductID string, forecast_week long, WeekStart date, "
                                       "predicted_Sales_Qty double, tier string, model string")


def test_assembly_guards(spark):
    d0 = dt.date(2025, 9, 22)
    tiers = spark.createDataFrame([(p,) for p in ("HV1", "HV2", "SP1", "SP2")], "ProductID string")
    rows = [(p, h, d0 + dt.timedelta(days=7 * (h - 1)), 1.0, "t", "m")
            for p in ("HV1", "HV2", "SP1", "SP2") for h in range(1, 13)]
    assert assemble.forecast_violations(_fc(spark, rows), tiers, 12).count() == 0
    dropped = [r for r in rows if r[0] != "SP2"]
    v = assemble.forecast_violations(_fc(spark, dropped), tiers, 12).collect()
    assert [(r["ProductID"], r["violation"]) for r in v] == [("SP2", "missing")]
    neg = [r if r[1] != 3 or r[0] != "HV1" else r[:3] + (-5.0,) + r[4:] for r in rows]
    v = assemble.forecast_violations(_fc(spark, neg), tiers, 12).collect()
    assert [r["violation"] for r in v] == ["negative"]


def test_sparse_selection_numbers_weeks(spark):
    d0 = dt.date(2025, 9, 22)
    fc = spark.createDataFrame([("S", d0 + dt.timedelta(days=7 * i), "TSB", 1.0) for i in (2, 0, 1)],
                               "unique_id string, ds date, model string, y_pred double")
    out = assemble.select_sparse(fc, "TSB").orderBy("WeekStart").collect()
    assert [r["forecast_week"] for r in out] == [1, 2, 3]


def test_backtest_one_baseline_per_tier_and_null_actuals_excluded(spark):
    d0 = dt.date(2025, 6, 30)
    valid = spark.createDataFrame([
        ("S1", d0, "TSB", 1.0, 1.0), ("S1", d0, "Naive", 2.0, 1.0),
        ("S1", d0 + dt.timedelta(days=7), "TSB", 5.0, None)],
        "unique_id string, ds date, model string, y_pred double, y double")
    hist = spark.createDataFrame([("S1", d0 - dt.timedelta(days=7), 1.0)], "unique_id string, ds date, y double")
    sp = scoring.score_sparse(valid, hist)
    rows = {r["model"]: r for r in sp.collect()}
    assert rows["TSB"]["wmape"] == 0.0 and rows["Naive"]["is_baseline"]
    hv = spark.createDataFrame([("P", d0, 1.0, "seasonal_naive", 2.0), ("P", d0, 1.0, "gbt", 1.0)],
                               "ProductID string, WeekStart date, y_true double, model string, y_pred double")
    comp = scoring.model_comparison(scoring.score_high_volume(hv), sp)
    base = comp.where(F.col("is_baseline")).groupBy("tier").count().collect()
    assert sorted((r["tier"], r["count"]) for r in base) == [("high_volume", 1), ("sparse", 1)]
