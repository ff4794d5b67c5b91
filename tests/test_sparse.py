import datetime as dt

from hebdocast.config import CROSTON, NAIVE, SBA, TSB, Cutoffs, Params
from hebdocast.operators import intermittent

D0 = dt.date(2025, 9, 1)


def _long(spark, rows):
    return spark.createDataFrame(rows, "unique_id string, ds date, y double")


def _ids(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "ProductID string")


def _fc(spark, rows, ids, last=D0):
    cut = Cutoffs.from_last_week(last, 12)
    return intermittent.final_forecast(_long(spark, rows), _ids(spark, ids), Params(), cut)


def test_one_observation_falls_back_to_last_value(spark):
    out = _fc(spark, [("SOLO", D0, 7.0)], ["SOLO"]).collect()
    assert len(out) == 12 * 4
    assert {r["y_pred"] for r in out} == {7.0}
    assert sorted({r["ds"] for r in out})[0] == D0 + dt.timedelta(days=7)


def test_carry_forward_and_empty(spark):
    rows = [("A", D0 - dt.timedelta(days=7), 3.0)]
    out = _fc(spark, rows, ["A", "EMPTY"], last=D0 - dt.timedelta(days=7))
    vals = {(r["unique_id"], r["y_pred"]) for r in out.collect()}
    assert ("EMPTY", 0.0) in vals and ("A", 3.0) in vals


def _brute_ses(x, a):
    level = x[0]
    for v in x[1:]:
        level = a * v + (1 - a) * level
    return level


def test_models_match_brute_force(spark):
    y = [0, 3, 0, 0, 5, 0, 2, 0, 0, 0, 4, 0]
    rows = [("S", D0 + dt.timedelta(days=7 * i), float(v)) for i, v in enumerate(y)]
    out = {r["model"]: r["y_pred"] for r in
           _fc(spark, rows, ["S"], last=D0 + dt.timedelta(days=7 * (len(y) - 1))).collect()}
    demand = [v for v in y if v]
    idx = [i for i, v in enumerate(y) if v]
    intervals = [idx[0] + 1] + [b - a for a, b in zip(idx, idx[1:])]
    croston = _brute_ses(demand, 0.1) / _brute_ses(intervals, 0.1)
    tsb = _brute_ses([1.0 if v else 0.0 for v in y], 0.1) * _brute_ses(demand, 0.1)
    assert abs(out[CROSTON] - croston) < 1e-12
    assert abs(out[SBA] - 0.95 * croston) < 1e-12
    assert abs(out[TSB] - tsb) < 1e-12
    assert out[NAIVE] == 0.0


def test_horizon_guard_names_short_series(spark):
    good = [("GOOD", D0 + dt.timedelta(days=7 * i), "TSB", 1.0) for i in range(12)]
    bad = [("BAD", D0 + dt.timedelta(days=7 * i), "TSB", 1.0) for i in range(5)]
    fc = spark.createDataFrame(good + bad, "unique_id string, ds date, model string, y_pred double")
    ids = spark.createDataFrame([("GOOD",), ("BAD",), ("NONE",)], "unique_id string")
    v = intermittent.horizon_violations(fc, 12, ids, ("TSB",)).collect()
    assert {(r["unique_id"], r["rows"]) for r in v} == {("BAD", 5), ("NONE", 0)}
    w = intermittent.horizon_violations(fc, 12, ids.limit(1), ("TSB", "SBA")).collect()
    assert [(r["model"], r["rows"]) for r in w] == [("SBA", 0)]


def test_fallback_rows_win_over_library_rows(spark):
    rows = [("A", D0, "TSB", 9.0, 0), ("A", D0, "TSB", 1.0, 1), ("B", D0, "TSB", 3.0, 0)]
    fc = spark.createDataFrame(rows, "unique_id string, ds date, model string, y_pred double, priority int")
    got = {(r["unique_id"], r["y_pred"]) for r in intermittent.keep_last(fc, "priority").collect()}
    assert got == {("A", 1.0), ("B", 3.0)}


def test_long_frame_keeps_tier(spark):
    from conftest import make_weekly
    w = make_weekly(spark, [("P1", D0, 1.0), ("P1", D0 + dt.timedelta(days=7), 2.0), ("P2", D0, 3.0)])
    tiers = spark.createDataFrame([("P1", "sparse"), ("P2", "high_volume")], "ProductID string, tier string")
    lg = intermittent.sparse_long(w, tiers)
    assert lg.columns == ["unique_id", "ds", "y"] and lg.count() == 2
