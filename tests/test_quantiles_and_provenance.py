"""Bracketed quantiles, correlation by products and the leakage guard by provenance."""
from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from conftest import featured_of, make_weekly, weeks
from pyspark.sql import Window
from pyspark.sql import functions as F

from hebdocast.config import CATEGORICAL_MODE_COLUMNS, Params
from hebdocast.functions.quantiles import bracketed_quantiles, rank_within_key
from hebdocast.operators import features, leakage, report


def frame(spark, columns):
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) and i % 2 else v for v in r) for i, r in enumerate(zip(*columns.values()))]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in columns)).repartition(4)


@pytest.mark.parametrize("few, accuracy", [(50_000, 2_000), (60, 40)])
def test_quantiles_equal_numpy(spark, few, accuracy):
    rnd = np.random.default_rng(4)
    n = 1_501
    columns = {"zeros": np.where(rnd.random(n) < 0.95, 0.0, rnd.normal(size=n)), "normal": rnd.normal(size=n), "ties": rnd.integers(0, 4, n) * 1.0,
               "one value": np.full(n, 7.5), "holes": np.where(rnd.random(n) < 0.6, np.nan, rnd.exponential(size=n)),
               "none": np.full(n, np.nan), "one": np.r_[3.0, np.full(n - 1, np.nan)], "wide": rnd.normal(size=n) * 10.0 ** rnd.integers(-9, 9, n)}
    columns = {c: [float(x) for x in v] for c, v in columns.items()}
    got = bracketed_quantiles(frame(spark, columns), list(columns), [0.0, 0.25, 0.5, 0.75, 1.0], accuracy, few)
    assert set(got) == set(columns) - {"none"}
    for c, q in got.items():
        want = np.nanquantile(np.array(columns[c]), [0, 0.25, 0.5, 0.75, 1])
        assert np.allclose(q, want, rtol=1e-12, atol=0), c


def test_ranks_over_many_ranges_equal_a_sort(spark):
    rnd = random.Random(3)
    rows = [("a", v) for v in {f"v{rnd.randrange(10**6):06d}" for _ in range(3000)}] + [("b", v) for v in "qwe"]
    rnd.shuffle(rows)
    got = {(r["k"], r["v"]): r["rank"] for r in rank_within_key(spark.createDataFrame(rows, "k string, v string"), partitions=7).collect()}
    assert got == {(k, v): i for k in "ab" for i, v in enumerate(sorted(v for x, v in rows if x == k))}
    assert rank_within_key(spark.createDataFrame([], "k string, v string")).collect() == []


def test_describe_of_an_empty_table(spark):
    assert report.describe(spark.createDataFrame([], "a double, b double"), ["a", "b"]).collect() == []


def test_correlation_of_hard_columns(spark):
    rnd = np.random.default_rng(7)
    n = 900
    a = rnd.normal(size=n)
    b = np.where(rnd.random(n) < 0.3, np.nan, a + rnd.normal(size=n))
    far = 1e8 + rnd.integers(0, 3, n)  # a small variance far from zero
    flag = np.where(np.isnan(b), 1e6, 5.0)  # constant wherever b is there
    columns = {"a": a, "b": b, "far": far, "flag": flag, "constant": np.full(n, 0.1), "none": np.full(n, np.nan)}
    df = frame(spark, {c: [float(x) for x in v] for c, v in columns.items()})
    got = {(r["feature_a"], r["feature_b"]): (r["n_pairs"], r["corr"]) for r in report.correlation_matrix(df, list(columns)).collect()}
    want = pd.DataFrame(columns).corr()
    assert len(got) == 15 and got["b", "flag"] == (int((~np.isnan(b)).sum()), None) and got["a", "none"] == (0, None)
    assert all(got[p][1] is None for p in got if "constant" in p or "none" in p)
    for p in (("a", "b"), ("a", "far"), ("b", "far"), ("a", "flag"), ("far", "flag")):
        assert abs(got[p][1] - want.loc[p]) < (1e-7 if "far" in p else 1e-9), p


# --- provenance -----------------------------------------------------------------------------------
def panel(spark, n=30):
    rows = [(p, w, float((i * 7 + k) % 5)) for k, p in enumerate(("A", "B")) for i, w in enumerate(weeks(n)) if (i + k) % 3 or i == 0]
    return features.dense_panel(make_weekly(spark, rows), weeks(n)[-1])


@pytest.mark.parametrize("column, frame_", [("Sales_Qty_rollmean_4", (-4, 0)), ("Sales_Qty_lag_1", (0, 0)), ("Sales_Qty_rollstd_12", (-12, 1)),
                                            ("zero_streak_length", (Window.unboundedPreceding, 1))])
def test_a_planted_input_of_the_same_week_is_found(spark, column, frame_):
    p = Params()
    assert leakage.panel_violations(panel(spark), p).count() == 0
    found = leakage.panel_violations(panel(spark), p, features.panel_reads(p) | {column: frame_}).collect()
    name = f"{column}_prev" if column in features.RUNNING else column
    assert {r["column"] for r in found} == {name} and {r["ProductID"] for r in found} == {"A", "B"}
    assert len(found) >= 2 * 29  # every week, but for the first or last one


def test_published_same_week_inputs_are_violations(spark):
    found = leakage.panel_violations(panel(spark), Params(feature_mode="contemporaneous"))
    assert {r["column"] for r in found.select("column").distinct().collect()} == {
        "dominant_dow", "pct_weekend_orders", "zero_streak_length", "cumulative_zero_weeks", "unit_price"}


def test_provenance_agrees_with_changes_of_the_values(spark):
    """Raise one week's quantity: only features whose source is that week or later may move, and the nearest ones do."""
    p, ws = Params(), weeks(30)
    base = panel(spark)
    at = ws[14]
    raised = base.withColumn("Sales_Qty", F.when(F.col("WeekStart") == F.lit(at), F.col("Sales_Qty") + 1000).otherwise(F.col("Sales_Qty")))
    holidays = spark.createDataFrame([], "WeekStart date")
    made = [features.add_features(x, holidays, p, model_lags=True) for x in (base, raised)]
    columns = [c for c in leakage.model_input_columns(p) if c not in CATEGORICAL_MODE_COLUMNS and c not in features.CALENDAR]
    one, two = ({(r["ProductID"], r["WeekStart"]): r for r in m.collect()} for m in made)
    sources = {(r["ProductID"], r["WeekStart"]): r for r in leakage.source_weeks(base, p).collect()}
    moved = {c: [k for k in one if one[k][c] != two[k][c]] for c in columns}
    for c, keys in moved.items():
        assert all(sources[k][c] >= at and k[1] > at for k in keys), c
    for c in ("Sales_Qty_lag_1", "Sales_Qty_lag_12", "Sales_Qty_rollmean_4", "Sales_Qty_rollstd_12", "zero_streak_length_prev"):
        assert moved[c], c


def test_source_weeks_are_the_nearest_rows(spark):
    rows = {(r["ProductID"], r["WeekStart"]): r for r in leakage.source_weeks(panel(spark), Params()).collect()}
    ws = weeks(30)
    assert rows["A", ws[0]]["Sales_Qty_lag_1"] is None and rows["A", ws[20]]["Sales_Qty_lag_12"] == ws[8]
    assert rows["A", ws[20]]["Sales_Qty_rollmean_12"] == ws[19] == rows["A", ws[20]]["zero_streak_length_prev"] == rows["A", ws[20]][leakage.TARGET_MEAN]


def test_features_with_and_without_model_lags_agree(spark):
    weekly = make_weekly(spark, [("A", w, float(i % 3)) for i, w in enumerate(weeks(20))])
    got = featured_of(spark, weekly)
    r = {x["WeekStart"]: x for x in got.collect()}
    ws = weeks(20)
    assert r[ws[5]]["zero_streak_length_prev"] == r[ws[4]]["zero_streak_length"] and r[ws[5]]["unit_price_prev"] == r[ws[4]]["unit_price"]
