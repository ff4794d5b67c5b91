import os


def test_write_stages_records_observed_rows(spark, tmp_path):
    from hebdocast.plans.flow import Flow
    from hebdocast.plans.run import write_stages
    from hebdocast.config import FIXTURE_PARAMS
    f = Flow.from_tables(spark, "/root/testdata/sf0.001", FIXTURE_PARAMS)
    m = write_stages(f, str(tmp_path), stages=("weekly", "tiers"))
    got = {(r["stage"], r["key"]): r["value"] for r in m.collect()}
    assert got[("weekly", "rows")] == spark.read.parquet(os.path.join(tmp_path, "weekly")).count()
    assert ("tiers", "seconds") in got and ("weekly", "sum_Sales_Qty") in got


def test_registered_queries_run_the_production_fit():
    from hebdocast.config import FIXTURE_PARAMS, Params
    fit = lambda p: {k: v for k, v in vars(p).items() if k.startswith("gbt_")}
    assert fit(FIXTURE_PARAMS) == fit(Params())
