"""Cleaning, scoping, weekly aggregation, quantiles, decomposition, correlation,
sinks — cases the published tests leave out."""
import datetime as dt
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from hebdocast.config import REQUIRED_COLUMNS
from hebdocast.operators import clean, report, scope, weekly
from hebdocast.sources.adapter import TRANSACTION_SCHEMA


def _tx(spark, rows):
    full = []
    for r in rows:
        base = dict.fromkeys(REQUIRED_COLUMNS)
        base.update(r)
        full.append(tuple(base[c] for c in REQUIRED_COLUMNS))
    return spark.createDataFrame(full, TRANSACTION_SCHEMA)


T0 = dt.datetime(2024, 1, 3)  # a Wednesday


def _row(pid="12345-001", rng="CLASSIC", qty=1.0, od=T0, inv=T0 + dt.timedelta(days=2), region="Asia",
         country="X"):
    return {"Region": region, "Country": country, "Product Code": pid + "-x", "Product Range": rng,
            "Sales Qty": qty, "Sales USD": qty * 2, "Order Date": od, "Invoice Date": inv,
            "Invoice No": "1"}


def test_artifacts_duplicates_and_imputation(spark):
    rows = [_row(), _row(), _row(qty=2.0, inv=T0 + dt.timedelta(days=4)),
            _row(qty=3.0, od=None, inv=T0 + dt.timedelta(days=10)),
            {"Region": "Total"}, {}, {"Region": "Applied filters: x"}]
    raw = _tx(spark, rows)
    assert clean.artifact_violations(raw).count() == 0
    res = clean.clean_transactions(raw)
    assert res.cleaned.count() == 3          # 1 duplicate, 3 artifacts dropped
    assert res.median_lead_days == 3          # leads 2 and 4 -> 3.0
    imputed = res.cleaned.where(F.col("Sales Qty") == 3.0).first()["Order Date"]
    assert imputed == T0 + dt.timedelta(days=7)


def test_median_truncates_toward_zero(spark):
    rows = [_row(qty=1.0, inv=T0 - dt.timedelta(days=1)), _row(qty=2.0, inv=T0 - dt.timedelta(days=2))]
    st = clean.lead_stats(clean.prepared(_tx(spark, rows))).first()
    assert st["median_lead_days"] == -1 and st["negative_lead_rate"] == 1.0


def test_scoping_keeps_null_range_and_normalises(spark):
    rows = [_row(rng=" promo "), _row(rng=None, qty=2.0), _row(rng="CLASSIC", qty=3.0)]
    c = clean.prepared(_tx(spark, rows))
    kept = scope.scope_products(c, ["PROMO"])
    assert sorted(r["Sales Qty"] for r in kept.collect()) == [2.0, 3.0]
    split = scope.split_products(c, ["PROMO"]).collect()
    assert [(r["kept_rows"], r["excluded_rows"]) for r in split] == [(2, 1)]


def test_weekly_floor_returns_and_modes(spark):
    rows = [_row(qty=-5.0, country="B"), _row(qty=2.0, country="A",
                                             od=T0 + dt.timedelta(days=3)),  # Saturday
            _row(qty=1.0, country="B", od=T0 + dt.timedelta(days=7))]
    wk = weekly.weekly_extended(clean.prepared(_tx(spark, rows))).orderBy("WeekStart").collect()
    assert wk[0]["WeekStart"] == dt.date(2024, 1, 1)
    assert wk[0]["Sales_Qty"] == 0.0 and wk[0]["returns_exceeded_sales"]
    assert wk[0]["Sales_USD"] == -6.0             # not floored
    assert wk[0]["Country"] == "A"                # tie -> lowest value
    assert wk[0]["pct_weekend_orders"] == 0.5 and wk[0]["dominant_dow"] == 2.0
    assert wk[1]["Sales_Qty"] == 1.0 and not wk[1]["returns_exceeded_sales"]


def test_exact_quantiles_match_numpy(spark):
    from hebdocast.functions.quantiles import exact_quantiles
    rng = np.random.default_rng(1)
    vals = rng.normal(size=1001).round(3)
    df = spark.createDataFrame([("a", float(v)) for v in vals] + [("b", float(v)) for v in vals[:10]],
                               "column string, value double")
    got = {(r["column"], r["prob"]): r["quantile"]
           for r in exact_quantiles(df, [0.25, 0.5, 0.75], partitions=7).collect()}
    for p in (0.25, 0.5, 0.75):
        assert math.isclose(got[("a", p)], float(np.quantile(vals, p)), abs_tol=1e-12)
        assert math.isclose(got[("b", p)], float(np.quantile(vals[:10], p)), abs_tol=1e-12)


def test_decomposition_matches_brute_force(spark):
    n, period = 120, 52
    t = np.arange(n)
    x = (10 + 0.1 * t + 3 * np.sin(2 * np.pi * t / period) + (t % 7)).astype(float)
    d0 = dt.date(2020, 1, 6)
    df = spark.createDataFrame([("P", d0 + dt.timedelta(days=7 * i), float(v)) for i, v in enumerate(x)],
                               "ProductID string, WeekStart date, Sales_Qty double")
    got = report.seasonal_decompose(df, period).orderBy("WeekStart").toPandas()
    filt = np.r_[0.5, np.ones(period - 1), 0.5] / period
    trend = np.full(n, np.nan)
    for i in range(period // 2, n - period // 2):
        trend[i] = np.dot(filt, x[i - period // 2:i + period // 2 + 1])
    det = x - trend
    pa = np.array([np.nanmean(det[i::period]) for i in range(period)])
    pa -= pa.mean()
    seasonal = np.tile(pa, n // period + 1)[:n]
    np.testing.assert_allclose(got["trend"].to_numpy(dtype=float), trend, rtol=1e-10, equal_nan=True)
    np.testing.assert_allclose(got["seasonal"].to_numpy(), seasonal, rtol=1e-9, atol=1e-9)


def test_pairwise_correlation_matches_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.normal(size=200), "b": rng.normal(size=200), "c": 5.0})
    pdf.loc[::7, "a"] = np.nan
    pdf.loc[::5, "b"] = np.nan
    pdf["b"] = pdf["b"] + pdf["a"].fillna(0)
    df = spark.createDataFrame(pdf)
    got = {(r["feature_a"], r["feature_b"]): r["corr"]
           for r in report.correlation_matrix(df, ["a", "b", "c"]).collect()}
    exp = pdf.corr()
    assert math.isclose(got[("a", "b")], exp.loc["a", "b"], rel_tol=1e-9)
    assert got[("a", "c")] is None  # constant column -> undefined


def test_sinks_round_trip(spark, tmp_path):
    from hebdocast.sources import tables
    df = spark.createDataFrame([(1, "a", 2.5)], "k long, s string, v double")
    tables.write_parquet(df, str(tmp_path / "p"))
    tables.write_csv(df, str(tmp_path / "c"))
    tables.write_json(df, str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "p")).collect() == df.collect()
    assert tables.read_csv(spark, str(tmp_path / "c"), df.schema).collect() == df.collect()
    assert tables.read_json(spark, str(tmp_path / "j"), df.schema).collect() == df.collect()


def test_missing_columns_raise(spark):
    import pytest

    from hebdocast.sources.tables import MissingColumnsError, require_columns
    with pytest.raises(MissingColumnsError, match="Region"):
        require_columns(spark.createDataFrame([(1,)], "x long"), ["Region"])


def test_lead_days_floor_with_times(spark):
    from hebdocast.functions.columns import days_between
    df = spark.createDataFrame([
        (dt.datetime(2024, 1, 3, 18), dt.datetime(2024, 1, 4, 6)),
        (dt.datetime(2024, 1, 3, 18), dt.datetime(2024, 1, 3, 6)),
        (dt.datetime(2024, 3, 1, 0), dt.datetime(2024, 4, 1, 0))], "o timestamp_ntz, i timestamp_ntz")
    got = [r[0] for r in df.select(days_between("i", "o")).collect()]
    assert got == [0, -1, 31]
