from conftest import featured_of, make_weekly, weeks


def _series(df, pid, col):
    return [r[col] for r in df.where(f"ProductID = '{pid}'").orderBy("WeekStart").collect()]


def test_zero_streak_and_cumulative(spark):
    w = weeks(5)
    weekly = make_weekly(spark, [("AAAAA-001", d, q) for d, q in zip(w, [5, 0, 0, 3, 0])])
    f = featured_of(spark, weekly)
    assert _series(f, "AAAAA-001", "zero_streak_length") == [0, 1, 2, 0, 1]
    assert _series(f, "AAAAA-001", "cumulative_zero_weeks") == [0, 1, 2, 2, 3]


def test_lag_one_is_previous_week(spark):
    w = weeks(5)
    weekly = make_weekly(spark, [("AAAAA-001", d, q) for d, q in zip(w, [5, 0, 0, 3, 0])])
    f = featured_of(spark, weekly)
    assert _series(f, "AAAAA-001", "Sales_Qty_lag_1") == [None, 5.0, 0.0, 0.0, 3.0]


def test_all_zero_and_all_nonzero_streaks(spark):
    w = weeks(4)
    rows = [("ZERO0-001", d, 0) for d in w] + [("NONZ0-001", d, q) for d, q in zip(w, [2, 4, 1, 5])]
    f = featured_of(spark, make_weekly(spark, rows))
    assert _series(f, "ZERO0-001", "zero_streak_length") == [1, 2, 3, 4]
    assert _series(f, "NONZ0-001", "zero_streak_length") == [0, 0, 0, 0]


def test_panel_starts_at_launch_and_has_no_gaps(spark):
    w = weeks(5)
    rows = [("EARLY-001", w[0], 3), ("EARLY-001", w[4], 7), ("LATE0-001", w[2], 9)]
    f = featured_of(spark, make_weekly(spark, rows))
    early = _series(f, "EARLY-001", "WeekStart")
    late = _series(f, "LATE0-001", "WeekStart")
    assert early == w and late == w[2:]
    assert _series(f, "EARLY-001", "Sales_Qty") == [3.0, 0.0, 0.0, 0.0, 7.0]
    assert _series(f, "EARLY-001", "transaction_count") == [1, 0, 0, 0, 1]


def test_rolling_uses_previous_rows_only(spark):
    w = weeks(6)
    f = featured_of(spark, make_weekly(spark, [("P0000-001", d, q)
                                               for d, q in zip(w, [1, 2, 3, 4, 5, 6])]))
    assert _series(f, "P0000-001", "Sales_Qty_rollmean_4") == [None, 1.0, 1.5, 2.0, 2.5, 3.5]
    std = _series(f, "P0000-001", "Sales_Qty_rollstd_4")
    assert std[0] is None and std[1] is None and abs(std[2] - 0.7071067811865476) < 1e-12


def test_mutation_leaves_model_inputs_unchanged(spark):
    from hebdocast.config import Params
    from hebdocast.operators import features
    from hebdocast.operators.leakage import model_input_columns
    w = weeks(20)
    rows = [("P0000-001", d, (i * 7) % 5) for i, d in enumerate(w)]
    weekly = make_weekly(spark, rows)
    base = featured_of(spark, weekly)
    mutated = make_weekly(spark, [(p, d, q + (1_000_000 if i == 5 else 0))
                                  for i, (p, d, q) in enumerate(rows)])
    mut = featured_of(spark, mutated)
    cols = model_input_columns(Params())
    b = base.orderBy("WeekStart").collect()[5]
    m = mut.orderBy("WeekStart").collect()[5]
    assert all(b[c] == m[c] for c in cols)
    # the published same-week inputs do move (documented leakage)
    cont = model_input_columns(Params(feature_mode="contemporaneous"))
    assert any(b[c] != m[c] for c in cont)
    assert features.lag_name(1) in cols
