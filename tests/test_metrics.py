import math

from hebdocast.functions.columns import mae, rmse, wmape


def _agg(spark, y, p, expr):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(list(zip([float(v) for v in y], [float(v) for v in p])), "y double, p double")
    return df.agg(expr(F.col("y"), F.col("p")).alias("m")).first()["m"]


def test_rmse_mae_known_arrays(spark):
    assert _agg(spark, [1, 2, 3, 4], [1, 2, 4, 4], rmse) == 0.5
    assert _agg(spark, [1, 2, 3, 4], [1, 2, 4, 4], mae) == 0.25


def test_outlier(spark):
    assert _agg(spark, [0, 0, 0, 0], [0, 0, 0, 10], mae) == 2.5
    assert _agg(spark, [0, 0, 0, 0], [0, 0, 0, 10], rmse) == 5.0


def test_wmape_zero_demand_weeks(spark):
    assert _agg(spark, [0, 0, 5, 0, 3], [0, 1, 4, 0, 3], wmape) == 0.25


def test_wmape_all_zero_actuals(spark):
    assert _agg(spark, [0, 0, 0], [1, 2, 3], wmape) == 0.0


def _mase(spark, y, p, hist):
    import datetime as dt

    from hebdocast.operators.scoring import mase_per_series
    d0 = dt.date(2020, 1, 6)
    valid = spark.createDataFrame(
        [("S", d0 + dt.timedelta(days=7 * (100 + i)), "m", float(b), float(a))
         for i, (a, b) in enumerate(zip(y, p))], "unique_id string, ds date, model string, y_pred double, y double")
    history = spark.createDataFrame(
        [("S", d0 + dt.timedelta(days=7 * i), float(v)) for i, v in enumerate(hist)],
        "unique_id string, ds date, y double")
    return mase_per_series(valid, history).first()["mase"]


def test_mase_known_value(spark):
    v = _mase(spark, [0, 0, 5, 0, 3], [0, 1, 4, 0, 3], [1, 0, 2, 0, 3, 0, 4])
    assert math.isclose(v, 0.4 / 2.5)


def test_mase_constant_history(spark):
    assert _mase(spark, [5, 6, 5], [5, 6, 5], [2, 2, 2, 2]) == 0.0
    assert math.isclose(_mase(spark, [5, 6, 5], [5, 5, 5], [2, 2, 2, 2]), 1 / 3)
