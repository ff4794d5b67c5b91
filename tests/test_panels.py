"""The trees' inputs as arrays against the windows of the panel."""
from __future__ import annotations

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hebdocast.config import CATEGORICAL_MODE_COLUMNS, FIXTURE_PARAMS
from hebdocast.operators import panels, regression

CODES = [f"{c}_code" for c in CATEGORICAL_MODE_COLUMNS]


@pytest.mark.parametrize("mode", ["lagged", "contemporaneous"])
def test_rows_and_states_equal_those_of_the_windows(spark, mode, monkeypatch):
    from hebdocast.plans.flow import Flow
    monkeypatch.setattr(panels, "CELLS", 3000)
    f = Flow.from_tables(spark, "/root/testdata/sf0.001", FIXTURE_PARAMS.with_(feature_mode=mode, high_volume_threshold=4))
    f.keep("weekly_ext")
    names, known = regression.numeric_inputs(f.params), lambda c: F.when(~F.isnan(c), F.col(c))
    params, last, holidays = f.params, f.cutoffs.valid_end, f.holiday_week_list
    inputs = [F.col(f"`{c}`").cast("double").alias(c) for c in [*names, *CODES]]
    wanted = f.hv_coded(CATEGORICAL_MODE_COLUMNS).select("ProductID", "WeekStart", "Sales_Qty", *inputs)
    xs = [f"x{i}" for i in range(len(inputs))]
    made = f.hv_weekly.mapInArrow(lambda b: panels.rows_of_panels(b, names, CODES, params, last, holidays),
                                  "id string, week int, y double, " + ", ".join(f"{x} double" for x in xs))
    made = made.select("id", F.date_add(F.lit(panels.EPOCH), F.col("week")), "y", *[known(x) for x in xs]).toDF(*wanted.columns)
    assert made.count() == wanted.count() > 1000 and made.exceptAll(wanted).isEmpty()  # to the last bit
    for week in (f.cutoffs.valid_end, f.cutoffs.train_end):
        state = regression.recursive_state(f.hv, week, regression.state_window(params))
        state = regression.apply_dictionary(state, f.cat_dictionary, CATEGORICAL_MODE_COLUMNS).select("ProductID", "history", *inputs)
        got = regression.coded_state(f.hv_weekly, params, week, holidays).select("ProductID", "history", *[known(c).alias(c) for c in [*names, *CODES]])
        assert got.count() == state.count() > 10 and got.exceptAll(state).isEmpty()
    assert "Window" not in f.hv_weekly._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
    f.close()


def test_products_that_batches_cut_stay_whole():
    ids = np.repeat(["a", "b", "c"], [5, 1, 7])
    day = np.concatenate([np.arange(5), [3], np.arange(7)]) * 14 + 4
    table = pa.table({"ProductID": ids, "day": day, "Sales_Qty": np.arange(13.0), "Sales_USD": np.ones(13), "dominant_dow": np.zeros(13),
                      "pct_weekend_orders": np.zeros(13)})
    last = panels.EPOCH + dt.timedelta(days=int(day.max()))
    names = ["Sales_Qty_lag_1", "Sales_Qty_rollmean_4"]

    def rows(size, cells):
        before, panels.CELLS = panels.CELLS, cells
        try:
            out = pa.Table.from_batches(panels.rows_of_panels(table.to_batches(size), names, (), FIXTURE_PARAMS, last, ()))
        finally:
            panels.CELLS = before
        return sorted(out.to_pylist(), key=lambda r: (r["id"], r["week"]))

    whole = rows(100, 1 << 16)
    assert len(whole) == 13 + 7 + 13 and sum(r["y"] for r in whole) == 78
    assert all(str(rows(size, cells)) == str(whole) for size in (1, 3) for cells in (1, 6, 20))
