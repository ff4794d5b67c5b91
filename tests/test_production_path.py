"""From the user's own file to the final forecast, and the guards that stop a run."""
from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hebdocast.config import GBT, Params
from hebdocast.operators import assemble, clean, country, regression, scope, tiers, weekly
from hebdocast.plans.flow import Flow
from hebdocast.plans.run import (FULL_STAGES, GuardError, distinct_estimates, enforce, read_stage, run,
                                 write_stages)
from hebdocast.plans.store import Store

FAST = Params(split_product_ids=None, gbt_max_iter=8, gbt_patience=3, gbt_min_instances=5,
              gbt_leaves=8, gbt_deep_depth=4, decomposition_min_weeks=60)
START = dt.datetime(2021, 1, 4)


def transactions(spark, weeks=80):
    """Two seasonal products sold every week and three sold now and then, with the three export rows."""
    from hebdocast.sources.adapter import TRANSACTION_SCHEMA, artifact_rows
    rnd = random.Random(1)
    rows = []

    def sale(week, code, qty):
        day = START + dt.timedelta(days=7 * week + rnd.randint(0, 4))
        rows.append(("Europe", "Germany", "1", "Customer", "Retail", "PREMIUM GRADE", "Shop", code, day,
                     day + dt.timedelta(days=3), str(len(rows)), 10.0 * qty, float(qty), 1.0))

    for w in range(weeks):
        sale(w, "HV000-001-A", 50 + 40 * (w % 12 < 6) + rnd.randint(-2, 2))
        sale(w, "HV000-002-A", 20 + 15 * (w % 12 < 4) + rnd.randint(-1, 1))
        if w % 17 == 3:
            for p in (1, 2, 3):
                sale(w, f"SP000-00{p}-A", p)
    return spark.createDataFrame(rows, TRANSACTION_SCHEMA).unionByName(artifact_rows(spark))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_file_to_forecast(spark, tmp_path, fmt):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    raw = transactions(spark)
    raw.write.parquet(path) if fmt == "parquet" else raw.write.option("header", True).csv(path)
    holidays = spark.createDataFrame([(dt.date(2021, 4, 2),), (dt.date(2022, 4, 15),)], "day date")
    flow = Flow.from_transactions(spark, path, FAST, fmt=fmt, holidays=holidays)
    metrics = run(flow, out) if fmt == "parquet" else write_stages(flow, out, ("prepared", "cleaned", "scoped", "weekly"))
    stages = {r["stage"] for r in metrics.collect()}
    if fmt == "csv":
        assert read_stage(spark, out, "weekly").count() == 160 + 15 and "rejects" in stages
        return
    assert stages == set(FULL_STAGES)
    fc = read_stage(spark, out, "forecast")
    assert {(r["ProductID"], r["n"]) for r in fc.groupBy("ProductID").agg(F.count("*").alias("n")).collect()} == {
        (p, 12) for p in ("HV000-001", "HV000-002", "SP000-001", "SP000-002", "SP000-003")}
    assert spark.read.option("header", True).csv(f"{out}/forecast_csv").count() == fc.count()
    scores = {r["model"]: r for r in read_stage(spark, out, "model_comparison").collect()}
    assert all(r["train_seconds"] is not None and r["inference_seconds"] is not None for r in scores.values())
    assert {GBT, f"{GBT}_recursive"} <= set(scores)
    featured = read_stage(spark, out, "featured")
    hit = {r["WeekStart"] for r in featured.where("is_lk_holiday_week").select("WeekStart").distinct().collect()}
    assert hit == {dt.date(2021, 3, 29), dt.date(2022, 4, 11)}


def test_trees_beat_seasonal_naive_on_a_seasonal_series(spark):
    """A yearly pattern of 52 weeks, which the 12-week naive model can't follow."""
    import math

    from conftest import make_weekly, weeks

    from hebdocast.operators import features
    rows = []
    for p in range(4):
        for i, w in enumerate(weeks(180)):
            rows.append((f"P{p}", w, 100.0 + 10 * p + 40 * math.sin(2 * math.pi * i / 52.18) + (i * 7 + p) % 3))
    weekly_df = make_weekly(spark, rows)
    flow = Flow(spark, weekly_df, FAST.with_(gbt_max_iter=30, gbt_patience=10, gbt_step=0.3))
    flow.__dict__["weekly_ext"] = weekly_df
    scores = {}
    for r in flow.hv_validation.collect():
        scores.setdefault(r["model"], []).append(abs(r["y_true"] - r["y_pred"]))
    mae = {m: sum(v) / len(v) for m, v in scores.items()}
    rmse = {m: (sum(x * x for x in v) / len(v)) ** 0.5 for m, v in scores.items()}
    for m in ("gbt", "gbt_deep"):
        assert mae[m] < mae["seasonal_naive"] and rmse[m] < rmse["seasonal_naive"]
        assert len(flow.hv_early[m].losses) >= len(flow.hv_trained[m].trees) == flow.hv_early[m].best()[0]
    assert flow.hv_forecast.groupBy("ProductID", "model").count().where("count <> 12").count() == 0


def test_recursion_of_a_constant_series_stays_constant(spark):
    from conftest import make_weekly, weeks
    rows = [(f"P{p}", w, 7.0) for p in range(4) for w in weeks(90)]
    weekly_df = make_weekly(spark, rows)
    flow = Flow(spark, weekly_df, FAST.with_(horizon=14, gbt_max_iter=2))
    flow.__dict__["weekly_ext"] = weekly_df
    got = flow.hv_forecast.collect()
    assert all(abs(r["predicted_Sales_Qty"] - 7.0) < 1e-6 for r in got)
    assert {r["forecast_week"] for r in got} == set(range(1, 15))
    assert len(got) == 4 * 14 * 3


def test_seasonal_naive_fallbacks_and_long_horizon(spark):
    h = [None] * 6 + [1.0, 2.0, 3.0, 4.0, 5.0, -6.0]
    st = spark.createDataFrame([("A", h), ("B", [None] * 12)], "ProductID string, history array<double>")
    fc = regression.seasonal_naive_forecast(st, dt.date(2024, 1, 1), 20).collect()
    a = [r["predicted_Sales_Qty"] for r in sorted(fc, key=lambda r: r["forecast_week"]) if r["ProductID"] == "A"]
    season = [0.0] * 6 + [1.0, 2.0, 3.0, 4.0, 5.0, 0.0]  # no value: the last one, clipped at 0
    assert a == season + season[:8]
    assert all(r["predicted_Sales_Qty"] == 0 for r in fc if r["ProductID"] == "B") and len(fc) == 40


def test_lead_days_below_one_second(spark):
    rows = [(dt.datetime(2024, 1, 1, 0, 0, 0, 500_000), dt.datetime(2024, 1, 2), 0), (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), 1),
            (dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 1, 23, 59, 59, 999_999), -1)]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "`Order Date` timestamp_ntz, `Invoice Date` timestamp_ntz")
    assert [r["lead_days"] for r in clean.lead_days(df).collect()] == [w for *_, w in rows]
    assert clean.lead_stats(df).first().asDict() == {"median_lead_days": 0, "negative_lead_rate": 1 / 3}


def test_guards_name_the_offenders(spark):
    day = "ProductID string, `Order Date` timestamp_ntz, `Invoice Date` timestamp_ntz, `Product Range` string"
    tx = spark.createDataFrame([("SHORT", None, None, " promo ")], day)
    found = {"id": clean.product_id_violations(tx), "dates": clean.impute_violations(tx),
             "week": weekly.week_floor_violations(tx), "scope": scope.scope_violations(tx, ("PROMO",)),
             "split": scope.named_split_violations(tx, ("PROMO",), ("SHORT",))}
    for name, rows in found.items():
        with pytest.raises(GuardError, match="SHORT"):
            enforce({name: rows})
    tier = spark.createDataFrame([("A", "sparse"), ("A", "sparse"), ("B", "odd")], "ProductID string, tier string")
    names = {(r["ProductID"], r["violation"]) for r in tiers.tier_violations(tier).collect()}
    assert names == {("A", "duplicate"), ("B", "no_tier")}
    fc = spark.createDataFrame([("A", "m1", 1, -1.0)], "ProductID string, model string, forecast_week long, predicted_Sales_Qty double")
    ids = spark.createDataFrame([("A",), ("B",)], "ProductID string")
    got = {(r["ProductID"], r["model"], r["violation"]) for r in regression.forecast_violations(fc, ids, 1, ("m1", "m2")).collect()}
    assert got == {("A", "m2", "horizon"), ("B", "m1", "horizon"), ("B", "m2", "horizon"), ("A", "m1", "negative")}
    assert {r["violation"] for r in assemble.forecast_violations(fc, ids, 1).collect()} == {"missing", "negative"}
    enforce({"nothing": tx.limit(0)})


def test_tiers_as_of_keep_later_products(spark):
    from conftest import make_weekly, weeks
    w = weeks(30)
    df = make_weekly(spark, [("OLD", x, 1.0) for x in w[:20]] + [("NEW", w[25], 1.0)])
    got = {r["ProductID"]: (r["tier"], r["transaction_count"]) for r in tiers.tier_products(df, 10, as_of=w[15]).collect()}
    assert got == {"OLD": ("high_volume", 16), "NEW": ("sparse", 0)}


def test_country_of_null_stays_apart(spark):
    ts = dt.datetime(2024, 1, 1)
    tx = spark.createDataFrame([("P", "DE", ts, 2.0, 1.0), ("P", None, ts, 3.0, 1.0)],
                               "ProductID string, Country string, `Order Date` timestamp_ntz, `Sales Qty` double, `Sales USD` double")
    got = country.country_weekly(tx).collect()
    assert {r["Country"] for r in got} <= {"DE", None} and len(got) >= 1


# --- published stages --------------------------------------------------------------------------
def written_input(spark, tmp_path, name="in"):
    path = str(tmp_path / name)
    transactions(spark, weeks=40).write.parquet(path)
    return path


def break_files(path):
    """Contents lost, names, sizes and times as they were: only a reader can tell."""
    import os
    for root, _, names in os.walk(path):
        for n in names:
            f = os.path.join(root, n)
            s = os.stat(f)
            with open(f, "r+b") as h:
                h.write(b"\0" * s.st_size)
            os.utime(f, ns=(s.st_atime_ns, s.st_mtime_ns))


def test_a_second_run_reads_no_source(spark, tmp_path):
    path, out = written_input(spark, tmp_path), str(tmp_path / "out")
    first = write_stages(Flow.from_transactions(spark, path, FAST), out).collect()
    break_files(path)
    again = write_stages(Flow.from_transactions(spark, spark.read.parquet(f"{out}/cleaned/*").inputFiles()[0], FAST), str(tmp_path / "x"), ()).collect()
    assert again == []
    flow = Flow(spark, transactions(spark).limit(0), FAST, source_path=path)
    second = {(r["stage"], r["key"]): r["value"] for r in write_stages(flow, out).collect()}
    assert {s for s, k in second if k == "skipped"} == {r["stage"] for r in first}
    assert all(second[r["stage"], r["key"]] == r["value"] for r in first)
    assert flow.weekly_ext.count() == second["weekly", "rows"]
    # other parameters make the stages anew
    with pytest.raises(Exception):
        write_stages(Flow(spark, spark.read.schema(transactions(spark).schema).parquet(path), FAST.with_(horizon=8), source_path=path), out)


def test_a_failing_guard_leaves_the_former_output(spark, tmp_path):
    out = str(tmp_path / "out")
    write_stages(Flow(spark, transactions(spark, 40), FAST), out, ("prepared", "cleaned", "scoped", "weekly"))
    before = read_stage(spark, out, "prepared").count()
    lost = transactions(spark, 60).where("Region is null or Region <> 'Total'")  # an artifact row is missing
    with pytest.raises(GuardError, match="artifact"):
        write_stages(Flow(spark, lost, FAST), out, ("prepared",))
    assert read_stage(spark, out, "prepared").count() == before
    assert len(Store(spark, out).listed(f"{out}/prepared")) == 1
    write_stages(Flow(spark, transactions(spark, 60), FAST), out, ("prepared",))
    write_stages(Flow(spark, transactions(spark, 50), FAST), out, ("prepared",))
    assert len(Store(spark, out).listed(f"{out}/prepared")) == 2  # the current and the former version
    assert len(Store(spark, out).listed(f"{out}/_manifest/prepared")) == 2


def test_guards_of_features_and_countries_run_in_the_path(spark, tmp_path, monkeypatch):
    from hebdocast.operators import features
    out = str(tmp_path / "out")
    flow = Flow(spark, transactions(spark, 40), FAST)
    reads = features.panel_reads(FAST) | {"Sales_Qty_rollmean_4": (-4, 0)}
    monkeypatch.setattr(features, "panel_reads", lambda p: reads)
    with pytest.raises(GuardError, match="leakage.*Sales_Qty_rollmean_4"):
        write_stages(flow, out, ("featured",))
    monkeypatch.undo()
    with pytest.raises(FileNotFoundError):
        read_stage(spark, out, "featured")
    two = transactions(spark, 40)
    more = two.where("Region = 'Europe'").withColumn("Country", F.lit("France")).unionByName(
        two.where("Region = 'Europe'").withColumn("Country", F.lit("Spain"))).unionByName(two)
    with pytest.raises(GuardError, match="country limit.*n_countries"):
        write_stages(Flow(spark, more, FAST), out, ("country_forecast",))
    write_stages(Flow(spark, more, FAST.with_(country_limit=3)), out, ("country_forecast",))
    assert read_stage(spark, out, "country_forecast").count() > 0


def exchanges_by_product(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("hashpartitioning(ProductID")


def test_stored_stages_keep_their_clustering(spark, tmp_path):
    from hebdocast.operators import features, leakage
    flow = Flow(spark, transactions(spark, 40), FAST)
    write_stages(flow, str(tmp_path / "out"), ("weekly", "featured"))
    tiers_ = flow.tiers.select("ProductID", "tier").hint("merge")
    windows = features.add_features(flow.panel_base, flow.holiday_weeks, FAST, model_lags=True)
    assert exchanges_by_product(windows) == 0
    assert exchanges_by_product(leakage.panel_violations(flow.featured_full, FAST)) == 0
    assert exchanges_by_product(flow.featured_full.join(tiers_, "ProductID")) == 0
    plain = spark.createDataFrame(flow.featured_full.collect(), flow.featured_full.schema)
    assert exchanges_by_product(leakage.panel_violations(plain, FAST)) > 0  # as it would be without buckets
    assert windows.count() == flow.featured_full.count()


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_rejects_are_kept_and_counted(spark, tmp_path, fmt):
    good = transactions(spark, 20)
    names = good.columns
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    text = good.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names])
    some = text.where("Region = 'Europe'").limit(1)
    bad = [some.withColumn("Sales Qty", F.lit("12x")), some.withColumn("Order Date", F.lit("2021-13-45")),
           some.withColumn("Sales USD", F.lit("a lot")).withColumn("Sales KG", F.lit("?"))]
    for b in bad:
        text = text.unionByName(b)
    text = text.coalesce(1)
    text.write.option("header", True).csv(path) if fmt == "csv" else text.write.json(path)
    flow = Flow.from_transactions(spark, path, FAST, fmt=fmt)
    metrics = {(r["stage"], r["key"]): r["value"] for r in write_stages(flow, out, ("prepared",)).collect()}
    assert metrics["rejects", "rows"] == 3 and metrics["prepared", "rows"] == good.count() - 3
    rejects = read_stage(spark, out, "rejects").collect()
    assert sorted(r["reason"] for r in rejects) == ["Order Date", "Sales Qty", "Sales USD, Sales KG"]
    assert all(r["record"] and r["file"] for r in rejects)


def test_malformed_lines_are_rejects(spark, tmp_path):
    from hebdocast.sources.adapter import TRANSACTION_SCHEMA
    from hebdocast.sources.tables import MissingColumnsError, read_checked
    names = TRANSACTION_SCHEMA.names
    row = ["Europe", "Germany", "1", "C", "B", "R", "S", "HV000-001-A", "2021-01-04", "2021-01-05", "1", "1.0", "2.0", "3.0"]
    (tmp_path / "x.csv").write_text("\n".join([",".join(names), ",".join(row), ",".join(row[:9]), ",".join([*row, "more"]), ",".join([""] * 14)]) + "\n")
    good, rejects = read_checked(spark, str(tmp_path / "x.csv"), "csv", TRANSACTION_SCHEMA)
    assert good.count() == 2 and {r["reason"] for r in rejects.collect()} == {"malformed record"} and rejects.count() == 2
    (tmp_path / "x.json").write_text("{\"" + "\": 1, \"".join(names) + "\": 1}\n{broken\n")
    good, rejects = read_checked(spark, str(tmp_path / "x.json"), "json", TRANSACTION_SCHEMA)
    assert good.count() == 0 or rejects.count() == 1
    (tmp_path / "y.csv").write_text("a,b\n1,2\n")
    with pytest.raises(MissingColumnsError):
        read_checked(spark, str(tmp_path / "y.csv"), "csv", TRANSACTION_SCHEMA)


# --- dictionary and sketches --------------------------------------------------------------------
def test_dictionary_grows_at_its_end(spark):
    columns = ("Region", "Country")
    old = spark.createDataFrame([("M", "x"), ("B", "x"), (None, "y")], "Region string, Country string")
    first = regression.category_dictionary(old, columns)
    new = spark.createDataFrame([("A", "z"), ("M", "w"), ("Z", None)], "Region string, Country string")
    codes = lambda d: {(r["column_name"], r["value"]): r["code"] for r in d.collect()}
    before = codes(first)
    unseen = regression.apply_dictionary(new, first, columns).select("Region", "Region_code").collect()
    assert {r["Region"]: r["Region_code"] for r in unseen} == {"A": None, "M": 1, "Z": None}
    after = codes(regression.extended_dictionary(first, new, columns))
    assert before.items() <= after.items()
    assert {k: v for k, v in after.items() if k not in before} == {("Region", "A"): 2, ("Region", "Z"): 3, ("Country", "w"): 2, ("Country", "z"): 3}
    assert codes(regression.extended_dictionary(regression.extended_dictionary(first, new, columns), old, columns)) == after
    assert codes(regression.extended_dictionary(first.limit(0), old, columns)) == before


def test_a_later_run_extends_the_stored_dictionary(spark, tmp_path):
    out = str(tmp_path / "out")
    stages = ("weekly", "featured", "tiers", "dictionary")
    write_stages(Flow(spark, transactions(spark, 40), FAST), out, stages)
    before = {(r["column_name"], r["value"]): r["code"] for r in read_stage(spark, out, "dictionary").collect()}
    tx = transactions(spark, 40)
    tx = tx.withColumn("Country", F.when(F.col("Product Code").startswith("HV000-001"), "Austria").otherwise(F.col("Country")))
    write_stages(Flow(spark, tx, FAST), out, stages)
    after = {(r["column_name"], r["value"]): r["code"] for r in read_stage(spark, out, "dictionary").collect()}
    assert before.items() <= after.items() and after["Country", "Austria"] == 1 and before["Country", "Germany"] == 0


def test_sketches_merge_in_any_order_and_stay_near(spark, tmp_path):
    from hebdocast.operators import profile
    df = spark.range(60_000).selectExpr("cast(id as string) as a", "id % 700 as b", "cast(null as string) as c")
    parts = [profile.distinct_sketches(df.where(f"pmod(hash(a), 3) = {k}"), ["a", "b", "c"]) for k in range(3)]
    one = {r["column_name"]: r["n_distinct"] for r in profile.merged_distinct(parts[0].unionByName(parts[1]).unionByName(parts[2])).collect()}
    two = {r["column_name"]: r["n_distinct"] for r in profile.merged_distinct(parts[2].unionByName(parts[0]).unionByName(parts[1])).collect()}
    error = 3 * 1.04 / 2 ** (profile.LG_K / 2)
    assert abs(one["a"] / 60_000 - 1) < error and abs(one["b"] / 700 - 1) < error and one["c"] == 0
    assert all(abs(one[k] - two[k]) <= 0.005 * one[k] for k in one)
    for k, weeks in enumerate((40, 50)):
        write_stages(Flow(spark, transactions(spark, weeks), FAST), str(tmp_path / str(k)), ("weekly",))
    got = {r["column_name"]: r["n_distinct"] for r in distinct_estimates(spark, [str(tmp_path / str(k)) for k in (0, 1)], "weekly").collect()}
    assert got["ProductID"] == 5 and got["Country"] == 1
