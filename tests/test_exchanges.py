"""Plans of the shared steps: which rows are dealt out anew, and which columns are computed."""
from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def shuffled(spark):
    """Joins by exchanges, as over large tables."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def flow_of(spark):
    from hebdocast.config import FIXTURE_PARAMS
    from hebdocast.plans.flow import Flow
    return Flow.from_tables(spark, SF, FIXTURE_PARAMS)


def test_equal_transactions_are_dropped_without_an_exchange_of_their_own(spark, shuffled):
    f = flow_of(spark)
    exchanges = lambda df: plan_of(df).count("Exchange hashpartitioning")
    # lineitem and part, customer and orders, then both by invoice
    assert exchanges(f.prepared) == exchanges(f.raw) == 6
    assert f.raw.count() == f.prepared.count() + 3 + f.raw.where("`Invoice No` % 997 = 0").count() // 2


def test_windows_by_product_need_no_exchange_behind_the_weekly_table(spark, shuffled):
    f = flow_of(spark).keep("prepared", "weekly_ext")
    try:
        plan = plan_of(f.panel_base.select("ProductID", "WeekStart", "Sales_Qty"))
        assert "Exchange" not in plan.split("InMemoryRelation")[0] and "Window" in plan
    finally:
        f.close()


def test_a_feature_query_computes_only_what_it_reads(spark):
    import __spark_entry__
    from hebdocast.plans import queries_core
    df = __spark_entry__.queries()["feat_zero_streak"](spark, SF)
    plan = plan_of(df).split("InMemoryRelation")[0]
    assert "Window" in plan and "stddev_samp" not in plan
    queries_core.flow(spark, SF).close()
    queries_core._SESSION_FLOWS.clear()


def test_a_tier_is_picked_before_its_panel_is_filled(spark, shuffled):
    from hebdocast.config import HIGH_VOLUME, SPARSE
    f = flow_of(spark).keep("prepared", "weekly_ext")
    try:
        for df in (f.sparse_long, f.featured_of(HIGH_VOLUME).select("ProductID", "WeekStart", "Sales_Qty_lag_1")):
            above, below = plan_of(df).split("Generate explode", 1)
            assert "Join" not in above and "LeftSemi" in below and "Exchange" not in below.split("InMemoryRelation")[0]
        for tier, rows in ((SPARSE, f.sparse_long.withColumnsRenamed({"unique_id": "ProductID", "ds": "WeekStart", "y": "Sales_Qty"})),
                           (HIGH_VOLUME, f.featured_of(HIGH_VOLUME))):
            whole = f.featured_full.join(f.tier_ids(tier), "ProductID", "left_semi").select(*rows.columns)
            assert whole.count() > 0 and whole.exceptAll(rows).isEmpty() and rows.exceptAll(whole).isEmpty()
    finally:
        f.close()


def test_the_dictionary_reads_a_row_a_product(spark, shuffled):
    f = flow_of(spark).keep("prepared", "weekly_ext")
    try:
        assert "Generate" not in plan_of(f.hv_modes).split("InMemoryRelation")[0]
        weekly = f.hv.select(*f.hv_modes.columns).distinct()
        assert weekly.count() == f.hv_modes.count() and weekly.exceptAll(f.hv_modes).isEmpty()
    finally:
        f.close()


def test_actuals_meet_forecasts_by_series(spark, shuffled):
    import datetime as dt

    from hebdocast.config import Cutoffs, Params
    from hebdocast.operators import intermittent
    last, week = dt.date(2025, 9, 1), lambda k: dt.date(2025, 9, 1) - dt.timedelta(days=7 * k)
    rows = [("A", week(k), float(k % 3)) for k in range(30)] + [("LATE", week(3), None), ("A", week(2), 9.0)]
    ids = spark.createDataFrame([("A",), ("LATE",), ("NONE",)], "ProductID string")
    cut = Cutoffs.from_last_week(last, 12)
    long = spark.createDataFrame(rows, "unique_id string, ds date, y double")
    out = intermittent.validation_fold(long, ids, Params(), cut)
    assert "ds#" not in "".join(line for line in plan_of(out).splitlines() if "Exchange hashpartitioning" in line)
    for model in ("TSB", "Naive"):
        got = sorted((r["unique_id"], r["ds"], r["y"] if r["y"] is not None else -1.0) for r in out.where(f"model = '{model}'").collect())
        want = [("A", week(k), float(k % 3)) for k in range(12)] + [("A", week(2), 9.0)]
        want += [(i, week(k), -1.0) for i in ("LATE", "NONE") for k in range(12)]
        assert got == sorted(want)


def test_the_assembled_forecast_is_counted_once(spark, shuffled):
    from hebdocast.operators import assemble
    rows = [("A", 1.0), ("A", 2.0), ("B", 1.0), ("C", -1.0), ("C", -2.0), ("EXTRA", 1.0), (None, 1.0)]
    fc = spark.createDataFrame(rows, "ProductID string, predicted_Sales_Qty double")
    tiers = spark.createDataFrame([("A",), ("B",), ("C",), ("GONE",), ("GONE",), (None,)], "ProductID string")
    out = assemble.forecast_violations(fc, tiers, 2)
    assert plan_of(out).count("Scan ExistingRDD") == 2
    want = [("B", "row_count"), ("C", "negative"), ("C", "negative"), ("EXTRA", "row_count"), ("GONE", "missing"), ("GONE", "missing"),
            ("", "missing"), ("", "row_count")]
    assert sorted((r["ProductID"] or "", r["violation"]) for r in out.collect()) == sorted(want)


def test_the_top_series_is_a_literal_of_the_plan(spark):
    from hebdocast.operators import report
    pred = spark.createDataFrame([("A", 1.0), ("B", 2.0), ("B", 1.0), ("C", 3.0), ("D", None)], "id string, y double")
    out = report.top_series(pred, "id", "y")
    assert "Join" not in plan_of(out) and [r["id"] for r in out.collect()] == ["B", "B"]
    assert report.top_series(pred.limit(0), "id", "y").collect() == []
