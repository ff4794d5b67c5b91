"""Boosted trees against a plain version of their rule, the recursion and the attributions."""
from __future__ import annotations

import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hebdocast.config import Params
from hebdocast.operators import attribution, boosting, regression

DAY0 = dt.date(2024, 1, 1)


def made(n=700, seed=3):
    """Rows with unknown values, ties, many zeros and categories."""
    rnd = np.random.default_rng(seed)
    a = np.where(rnd.random(n) < 0.5, 0.0, rnd.integers(1, 40, n).astype(float))
    b = np.where(rnd.random(n) < 0.2, np.nan, rnd.normal(size=n).round(1))
    c = np.where(rnd.random(n) < 0.1, np.nan, rnd.integers(0, 6, n).astype(float))
    y = 3.0 * (a > 11) + np.nan_to_num(b, nan=2.5) * 2 + np.array([0, 5, 1, 4, 2, 7])[np.nan_to_num(c).astype(int)] + rnd.normal(size=n).round(2)
    return a, b, c, y, rnd.integers(0, 10, n)


@pytest.fixture(scope="module")
def stored_matrix(spark):
    a, b, c, y, week = made()
    none = lambda x: None if math.isnan(x) else float(x)
    rows = [(f"P{i}", DAY0 + dt.timedelta(days=7 * int(week[i])), float(y[i]), none(a[i]), none(b[i]), None if math.isnan(c[i]) else int(c[i]))
            for i in range(len(y))]
    df = spark.createDataFrame(rows, "ProductID string, WeekStart date, Sales_Qty double, a double, b double, c_code int").repartition(3)
    binning = boosting.fit_binning(df, ["a", "b"], {"c": 6}, max_bins=24)
    return boosting.matrix(df, binning, rows=100), binning


ALL = (boosting.day(DAY0), boosting.day(DAY0) + 7 * 6)
HELD = (ALL[1] + 1, ALL[1] + 1000)


def plain_trees(blocks, binning, rules, base, scale, rounds):
    """One split after another, each found by trying every threshold on the rows themselves."""
    rows = blocks.collect()
    weeks = np.concatenate([r["weeks"] for r in rows])
    y = np.concatenate([np.frombuffer(r["y"]) for r in rows])
    x = np.concatenate([np.frombuffer(r["bins"], np.uint8).reshape(len(binning.names), -1) for r in rows], 1)
    fit = (weeks >= ALL[0]) & (weeks <= ALL[1])
    f, trees = np.full(len(y), base), []

    def split_of(at, q):
        def score(v):
            return v.sum() ** 2 / (len(v) + rules.l2) if len(v) else 0.0
        best = None
        for k in range(len(x)):
            v = x[k, at]
            present = [u for u in np.unique(v) if u]
            order = list(range(1, int(v.max(initial=0)) + 1))
            if binning.is_nominal[k]:
                order = sorted(present, key=lambda u: (q[v == u].sum() / ((v == u).sum() + boosting.SMOOTH), u))
            for cut, side in itertools.product(range(len(order)), (False, True)):
                if side and not (v == 0).any():
                    continue
                chosen = set(order[:cut + 1]) | ({0} if side else set())
                left = np.isin(v, list(chosen))
                if min(left.sum(), (~left).sum()) < max(rules.min_rows, 1):
                    continue
                gain = score(q[left]) + score(q[~left]) - score(q)
                key = (gain, -k, -cut, -side)
                if gain > 1e-9 * score(q) and (best is None or key > best[0]):
                    best = key, k, left
        return best

    for _ in range(rounds):
        q = np.rint((y - f) * scale)
        leaves = [(np.flatnonzero(fit), 0)]
        found = {0: split_of(leaves[0][0], q[leaves[0][0]])}
        open_, done, born = [0], 0, 1
        parts = {0: (leaves[0][0], 0, np.arange(len(y)))}
        while open_ and done < (rules.leaves or 10 ** 6) - 1:
            able = [k for k in open_ if found[k] and (rules.depth is None or parts[k][1] < rules.depth)]
            if not able:
                break
            k = max(able, key=lambda j: (found[j][0][0], -j)) if rules.leaves else able[0]
            _, feature, left = found[k]
            at, level, everyone = parts[k]
            values = set(x[feature, at[left]].tolist())
            goes = np.isin(x[feature, everyone], list(values))
            if not binning.is_nominal[feature]:  # thresholds also hold for bins that the leaf doesn't have
                top = max(v for v in values)
                goes = ((x[feature, everyone] >= 1) & (x[feature, everyone] <= top)) | ((x[feature, everyone] == 0) & (0 in values))
            open_.remove(k)
            for side, all_side in ((at[left], everyone[goes]), (at[~left], everyone[~goes])):
                parts[born] = side, level + 1, all_side
                found[born] = split_of(side, q[side])
                open_.append(born)
                born += 1
            done += 1
        step = np.zeros(len(y))
        for k in open_:
            at, _, everyone = parts[k]
            step[everyone] = rules.step * q[at].sum() / (len(at) + rules.l2) / scale
        trees.append((done, step[fit]))
        f = f + step
    return trees, f[fit], x[:, fit]


@pytest.mark.parametrize("rules", [boosting.Rules(step=0.3, rounds=3, leaves=12, min_rows=10),
                                   boosting.Rules(step=0.3, rounds=3, depth=3, min_rows=4, l2=1.0)])
@pytest.mark.parametrize("in_task_bytes", [0, 1 << 20])
def test_trees_equal_plain_splits(stored_matrix, rules, in_task_bytes):
    blocks, binning = stored_matrix
    model = boosting.Ensemble("m", rules, ALL)
    boosting.grow(blocks, binning, [model], in_task_bytes)
    trees, f, x = plain_trees(blocks, binning, rules, model.base, model.scale, 3)
    assert [(t.feature >= 0).sum() for t in model.trees] == [n for n, _ in trees]
    assert np.allclose(model.predict(x), f, atol=1e-9)
    for t in model.trees:  # covers add up
        inner = t.feature >= 0
        assert (t.rows[inner] == t.rows[t.left[inner]] + t.rows[t.right[inner]]).all()


def same(a, b):
    return len(a.trees) == len(b.trees) and a.losses == b.losses and all(
        (s.feature == t.feature).all() and (s.value == t.value).all() and (s.mask == t.mask).all() for s, t in zip(a.trees, b.trees))


def test_passes_and_tasks_give_the_same_trees_and_patience_needs_no_restart(stored_matrix):
    blocks, binning = stored_matrix
    rules = [boosting.Rules(step=0.4, rounds=200, leaves=6, patience=4), boosting.Rules(step=0.4, rounds=21, depth=2, patience=200)]
    make = lambda: [boosting.Ensemble(str(k), r, ALL, HELD) for k, r in enumerate(rules)]
    by_pass, in_task = make(), make()
    boosting.grow(blocks, binning, by_pass, 0)
    boosting.grow(blocks, binning, in_task)
    assert all(same(a, b) for a, b in zip(by_pass, in_task))
    best, stopped = by_pass[0].best()
    assert stopped and len(by_pass[0].trees) == best + 4 < 200
    assert len(by_pass[1].trees) == 21 == len(by_pass[1].losses) and by_pass[1].losses[-1] < by_pass[1].losses[0]


@pytest.mark.parametrize("in_task_bytes", [0, 1 << 20])
def test_an_ensemble_grows_on(stored_matrix, in_task_bytes):
    blocks, binning = stored_matrix
    short = boosting.Ensemble("m", boosting.Rules(step=0.3, rounds=3, leaves=5), ALL)
    whole = boosting.Ensemble("m", boosting.Rules(step=0.3, rounds=6, leaves=5), ALL)
    boosting.grow(blocks, binning, [short], in_task_bytes)
    kept = list(short.trees)
    short.rules = whole.rules
    boosting.grow(blocks, binning, [short], in_task_bytes)
    boosting.grow(blocks, binning, [whole], in_task_bytes)
    assert same(short, whole) and len(short.trees) == 6 and all((a.value == b.value).all() for a, b in zip(kept, short.trees))


@pytest.mark.parametrize("folder", [None, "far://store/counts"])
def test_tasks_side_by_side_give_the_trees_of_passes_without_a_job_a_pass(spark, stored_matrix, monkeypatch, folder):
    blocks, binning = stored_matrix
    rounds = (9, 200) if folder is None else (2, 2)  # a barrier's own exchange takes a second
    rules = [boosting.Rules(step=0.4, rounds=rounds[1], leaves=6, patience=4), boosting.Rules(step=0.4, rounds=rounds[0], depth=3, patience=200)]
    make = lambda: [boosting.Ensemble(str(k), r, ALL, HELD) for k, r in enumerate(rules)]
    by_pass, together = make(), make()
    boosting.grow(blocks, binning, by_pass, 0)
    monkeypatch.setattr(boosting, "_pass", None)
    if folder is not None:
        monkeypatch.setattr(boosting, "scratch", lambda *_: folder)
    size = sum(len(r["bins"]) for r in blocks.collect())
    assert boosting._slots(spark) > 1
    boosting.grow(blocks, binning, together, size - 1)  # larger than a task holds alone
    assert all(same(a, b) for a, b in zip(by_pass, together)) and len(together[1].trees) == rounds[0]
    if folder is not None:
        return
    short = make()
    short[1].rules = boosting.Rules(step=0.4, rounds=1, depth=3, patience=200)
    boosting.grow(blocks, binning, short[1:], size - 1)
    short[1].rules = rules[1]
    boosting.grow(blocks, binning, short[1:], size - 1)  # grows on
    assert all((s.value == t.value).all() for s, t in zip(by_pass[1].trees, short[1].trees))


def test_inputs_counted_at_once_give_the_counts_of_each():
    rnd = np.random.default_rng(5)
    widths = [128, 128, 13, 5, 256, 3, 2]
    n = boosting.MANY_JOINT + 77
    bins = np.stack([rnd.integers(0, w, n) for w in widths]).astype(np.uint8)
    q = np.rint(rnd.normal(0, 5e4, n))
    joint = boosting._Joint([bins[:, :1000], bins[:, 1000:]], widths)
    assert len(joint.groups) < len(widths) and (joint.bins() == bins).all()
    assert all(np.prod([widths[k] for k in g]) <= boosting.CELLS for g in joint.groups)
    for rows in (slice(None), np.flatnonzero(rnd.random(n) < 0.1)):
        plain = boosting._counted(bins[:, rows], q[rows], None, 1, 256)[0]
        assert (joint.rows(rows).counted(q[rows], 256) == plain).all()


def test_inputs_that_repeat_each_other_share_a_number():
    rnd = np.random.default_rng(6)
    n = 5 * boosting.MANY_JOINT + 3
    week = rnd.integers(0, 350, n)
    sold = np.where(rnd.random(n) < 0.98, 0, rnd.integers(1, 54, n))  # mostly nothing
    country = rnd.integers(1, 26, n)
    bins = np.stack([week % 54, week // 5, 1 + week % 13, country, country // 6, sold, np.roll(sold, 1), rnd.integers(0, 126, n)]).astype(np.uint8)
    widths = [54, 72, 14, 26, 6, 54, 54, 126]
    joint = boosting._Joint([bins[:, :70], bins[:, 70:]], widths)
    assert len(joint.groups) == 2 and (joint.bins() == bins).all()  # four by the product of the widths
    q = np.rint(rnd.normal(0, 5e4, n))
    q[::7] = 1 << 20  # too many rows for one number at these sums: they are added up part by part
    for rows in (None, np.flatnonzero(rnd.random(n) < 0.5), np.flatnonzero(rnd.random(n) < 0.01)):
        some = slice(None) if rows is None else rows
        assert (joint.counted(q, 126, rows) == boosting._counted(bins[:, some], q[some], None, 1, 126)[0]).all()


def test_cuts_come_from_summaries_of_each_task(spark, monkeypatch):
    df = spark.range(0, 40_000, 1, 6).select(
        F.when(F.col("id") % 5 == 0, (F.hash("id") % 20_000).cast("double")).otherwise(0.0).alias("a"),
        F.when(F.col("id") % 7 > 0, F.hash("id", F.lit(1)).cast("double")).alias("b"), (F.col("id") % 3).alias("c"),
        F.lit(None).cast("double").alias("none"), F.lit(float("nan")).alias("nan"))
    rows = df.toPandas()
    shares = np.linspace(0, 1, 64)[:-1]

    def exact(x):
        x = np.sort(x)
        return x[np.maximum(1, np.ceil(shares * len(x))).astype(int) - 1].tolist() if len(x) else []

    plans = []
    monkeypatch.setattr(F, "percentile_approx", lambda *a: plans.append(a))
    got = boosting.fit_binning(df, list(df.columns), {})
    for name, cuts in zip(df.columns, got.cuts):
        x = rows[name].dropna().to_numpy(np.float64)
        assert cuts == tuple(sorted({*exact(x), *exact(x[x != 0])}))
    assert not plans  # sketches that one task merges
    monkeypatch.setattr(boosting, "POINTS", 2_000)
    v, n = boosting._summary(*boosting._distinct([rows["b"].dropna().to_numpy()]), np.array([1.5]), np.array([3]))
    every = np.sort(np.append(rows["b"].dropna(), [1.5] * 3))
    assert len(v) <= 2_000 and n.sum() == len(every) and v[-1] == every[-1]
    assert (v == every[np.cumsum(n) - 1]).all() and n.max() <= 2 * len(every) / 2_000 + 3


def test_rows_of_several_blocks_are_attributed_at_once(stored_matrix, monkeypatch):
    from hebdocast.operators import attribution
    blocks, binning = stored_matrix
    model = boosting.Ensemble("m", boosting.Rules(step=0.4, rounds=2, leaves=5), ALL)
    boosting.grow(blocks, binning, [model])
    batches = blocks.toArrow().to_batches()
    rows, whole = sum(b.num_rows for b in batches), attribution.ensemble_values
    asked = []
    monkeypatch.setattr(attribution, "ensemble_values", lambda e, bins: asked.append(bins.shape[1]) or whole(e, bins))
    found = list(attribution.attributed(batches, model, HELD, len(binning.names)))
    assert rows > 1 and len(asked) == 1 == len(found) and asked[0] == found[0].num_rows
    monkeypatch.setattr(attribution, "BLOCK_ROWS", 1)
    single = list(attribution.attributed(batches, model, HELD, len(binning.names)))
    assert len(single) > 1 and sum(b.num_rows for b in single) == asked[0]
    for name in ("ProductID", "week"):
        assert [x for b in single for x in b.column(name).to_pylist()] == found[0].column(name).to_pylist()
    values = lambda bs: np.concatenate([b.column("values").flatten().to_numpy() for b in bs])
    assert np.allclose(values(single), values(found), atol=1e-9)


def test_empty_and_constant_targets(spark, stored_matrix):
    blocks, binning = stored_matrix
    nothing = boosting.Ensemble("m", boosting.Rules(step=0.3, rounds=2, leaves=5), (1, 2))
    boosting.grow(blocks, binning, [nothing])
    assert nothing.base == 0 and all(len(t.feature) == 1 for t in nothing.trees)
    model = boosting.Ensemble("m", boosting.Rules(step=0.3, rounds=2, leaves=5), ALL)
    boosting.grow(blocks.limit(0), binning, [model])
    assert boosting.predictions(blocks.limit(0), model, ALL, 3).count() == 0


def test_best_round_waits_for_patience():
    assert boosting.best_round([5, 4, 4.5, 4.2, 3.9, 4, 4, 4], 3) == (5, True)
    assert boosting.best_round([5, 4, 4.5, 4.2, 3.9, 4], 3) == (5, False)
    assert boosting.best_round([5, 4, 4.5, 4.2, 4.1, 3.9], 3) == (2, True)


def test_bins_keep_zeros_apart_and_unknown_codes_together():
    binning = boosting.Binning(("a",), ("c",), ((0.0, 2.0, 5.0),), (300,))
    got = binning.apply([np.array([-1, 0, 1, 2, 5, 9, np.nan]), np.array([0, 1, 253, 254, 299, np.nan, 2])])
    assert got.tolist() == [[1, 1, 2, 2, 3, 4, 0], [1, 2, 254, 255, 255, 0, 3]] and binning.bins == 256


# --- recursion ---------------------------------------------------------------------------------
def test_one_pass_equals_the_recursion_step_by_step(spark, stored_matrix):
    p = Params()
    rnd = np.random.default_rng(1)
    window = regression.state_window(p)
    rows = []
    for i in range(9):
        h = [None if j < i else float(rnd.integers(0, 9)) for j in range(window)]
        rows.append((f"P{i}", h, float(i % 3), None if i == 4 else i % 4))
    state = spark.createDataFrame(rows, "ProductID string, history array<double>, product_mean_qty double, Country_code int")
    names = regression.numeric_inputs(p)
    cuts = tuple(tuple(np.arange(0, 60, 1.5).tolist()) for _ in names)
    binning = boosting.Binning(tuple(names), ("Country",), cuts, (4,))
    model = boosting.Ensemble("m", boosting.Rules(step=1.0, rounds=1, leaves=2), ALL)
    model.base = 1.0
    for _ in range(25):  # random trees over all inputs
        t = boosting.Tree()
        for k in range(7):
            t.add(float(rnd.normal()), 1)
        for k in range(3):
            t.feature[k], t.left[k], t.right[k], t.mask[k] = int(rnd.integers(0, len(names) + 1)), 2 * k + 1, 2 * k + 2, rnd.random(256) < 0.5
        t.depth = 2
        model.trees.append(t.frozen())
    origin, holidays = dt.date(2024, 11, 25), [dt.date(2024, 12, 23)]
    got = regression.recursive_forecast(model, binning, state, p, origin, holidays, steps=14)
    found = {(r["ProductID"], r["forecast_week"]): r["predicted_Sales_Qty"] for r in got.collect()}
    assert len(found) == 9 * 14
    st = state
    for step in range(14):
        week = origin + dt.timedelta(days=7 * step)
        x = regression.step_features(st, week, holidays, p).collect()
        columns = [np.array([np.nan if c not in r or r[c] is None else float(r[c]) for r in x]) for c in [*names, "Country_code"]]
        preds = np.maximum(model.predict(binning.apply(columns)), 0)
        for r, v in zip(x, preds):
            assert abs(found[r["ProductID"], step + 1] - v) < 1e-9
        rows = [(r["ProductID"], [*r["history"][1:], float(v)], r["product_mean_qty"], r["Country_code"]) for r, v in zip(x, preds)]
        st = spark.createDataFrame(rows, state.schema)


# --- attributions ----------------------------------------------------------------------------------
def expectation(tree, x, known, node=0):
    """Expected value of a tree where only the inputs ``known`` are known, by row counts."""
    k = tree.feature[node]
    if k < 0:
        return tree.value[node]
    a, b = tree.left[node], tree.right[node]
    if k in known:
        return expectation(tree, x, known, a if tree.mask[node, x[k]] else b)
    return (expectation(tree, x, known, a) * tree.rows[a] + expectation(tree, x, known, b) * tree.rows[b]) / tree.rows[node]


def test_attributions_equal_all_subsets_and_add_up(stored_matrix):
    blocks, binning = stored_matrix
    model = boosting.Ensemble("m", boosting.Rules(step=0.3, rounds=6, leaves=10, min_rows=5), ALL)
    boosting.grow(blocks, binning, [model])
    rows = attribution.attributions(blocks, model, HELD, 3).collect()
    assert len(rows) > 100 and {len(r["values"]) for r in rows} == {3}
    for r in rows:
        assert abs(r["base"] + sum(r["values"]) - r["y_pred"]) < 1e-6
    bins = np.concatenate([np.frombuffer(r["bins"], np.uint8).reshape(3, -1) for r in blocks.collect()], 1)[:, :25]
    base, values = attribution.ensemble_values(model, np.ascontiguousarray(bins))
    for i in range(25):
        for k in range(3):
            want = 0.0
            others = [j for j in range(3) if j != k]
            for size in range(3):
                for chosen in itertools.combinations(others, size):
                    w = math.factorial(size) * math.factorial(2 - size) / math.factorial(3)
                    want += w * sum(expectation(t, bins[:, i], {*chosen, k}) - expectation(t, bins[:, i], set(chosen)) for t in model.trees)
            assert abs(values[i, k] - want) < 1e-9
    mean = {r["feature"]: r["mean_abs_attribution"] for r in attribution.mean_absolute(
        attribution.attributions(blocks, model, HELD, 3), binning.names).collect()}
    assert all(abs(mean[c] - np.mean([abs(r["values"][k]) for r in rows])) < 1e-9 for k, c in enumerate(binning.names))
    worse = {r["feature"]: r["permutation_rmse_increase"] for r in attribution.permutation_errors(blocks, model, ALL, binning.names).collect()}
    assert all(v > 0 for v in worse.values()) and abs(sum(boosting.gain_importance(model, binning.names)) - 1) < 1e-9


def test_long_paths_use_more_than_one_byte_of_patterns():
    rnd = np.random.default_rng(2)
    t = boosting.Tree()
    t.add(0.0, 1 << 12)
    node = 0
    for k in range(11):  # a chain over eleven inputs
        rows = t.rows[node]
        a, b = t.add(float(rnd.normal()), rows // 2), t.add(float(rnd.normal()), rows - rows // 2)
        t.feature[node], t.left[node], t.right[node], t.mask[node] = k, a, b, np.arange(256) < 2
        node, t.depth = a, k + 1
    tree = t.frozen()
    bins = rnd.integers(1, 3, (11, 60)).astype(np.uint8)
    out = np.zeros((60, 11))
    base = attribution.tree_values(tree, bins, out)
    assert np.allclose(base + out.sum(1), tree.value[tree.places(bins)])
    assert abs(base - expectation(tree, bins[:, 0], set())) < 1e-12


def test_rmse_is_no_worse_than_level_wise_trees_of_the_ml_library(spark):
    """A yearly pattern, one step ahead, with the same rounds, step and tree size."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    rows = []
    for p in range(4):
        s = [100.0 + 10 * p + 40 * math.sin(2 * math.pi * i / 52.18) + (i * 7 + p) % 3 for i in range(180)]
        rows += [(f"P{p}", DAY0 + dt.timedelta(days=7 * i), s[i], s[i - 1], s[i - 2], s[i - 12], float(i % 52)) for i in range(12, 180)]
    df = spark.createDataFrame(rows, "ProductID string, WeekStart date, Sales_Qty double, l1 double, l2 double, l12 double, w double")
    cut = DAY0 + dt.timedelta(days=7 * 160)
    inputs = ["l1", "l2", "l12", "w"]
    binning = boosting.fit_binning(df.where(F.col("WeekStart") < cut), inputs, {})
    blocks = boosting.matrix(df, binning)
    model = boosting.Ensemble("m", boosting.Rules(step=0.3, rounds=20, leaves=8, min_rows=5), (0, boosting.day(cut) - 1))
    boosting.grow(blocks, binning, [model])
    ours = boosting.predictions(blocks, model, (boosting.day(cut), 10 ** 6), 4).agg(F.sqrt(F.avg(F.pow(F.col("y_true") - F.col("y_pred"), 2)))).first()[0]
    x = VectorAssembler(inputCols=inputs, outputCol="features").transform(df)
    fit = GBTRegressor(labelCol="Sales_Qty", maxDepth=3, stepSize=0.3, maxIter=20, minInstancesPerNode=5, maxBins=128, seed=1).fit(x.where(F.col("WeekStart") < cut))
    theirs = fit.transform(x.where(F.col("WeekStart") >= cut)).agg(F.sqrt(F.avg(F.pow(F.col("Sales_Qty") - F.col("prediction"), 2)))).first()[0]
    assert ours <= theirs * 1.02


def test_passes_read_predictions_and_follow_only_counted_nodes(stored_matrix, monkeypatch):
    blocks, binning = stored_matrix
    model = boosting.Ensemble("m", boosting.Rules(step=0.3, rounds=boosting.STORE + 3, leaves=5), ALL, HELD)
    seen, plain = [], boosting._pass

    def spied(state, asks, *rest):
        seen.append((len(asks[0].since), "products" in state.columns))
        return plain(state, asks, *rest)

    monkeypatch.setattr(boosting, "_pass", spied)
    boosting.grow(blocks, binning, [model], 0)
    assert len(model.trees) == boosting.STORE + 3 and set(seen) == {(0, False)}  # no tree is evaluated again by a pass
    tree, bins = model.trees[0], np.random.default_rng(1).integers(0, binning.bins, (3, 500)).astype(np.uint8)
    place, at = tree.places(bins), np.arange(0, 500, 2)
    leaves = [k for k in range(len(tree.feature)) if tree.feature[k] < 0][:3]
    for k, rows in zip(leaves, tree.rows_at(bins, leaves, at)):
        assert rows.tolist() == [i for i in at if place[i] == k]


def test_rows_of_a_large_block_end_where_its_path_leads():
    rng = np.random.default_rng(7)
    n = 3 * boosting.MANY_ROWS
    bins = rng.integers(0, 12, (5, n)).astype(np.uint8)
    tree, open_ = boosting.Tree(), [0]
    tree.add(0.0, n)
    for i in range(40):
        k = open_.pop(0)
        tree.left[k], tree.right[k] = (tree.add(rng.random(), 1) for _ in range(2))
        mask = np.zeros(256, bool)
        mask[:12] = rng.random(12) < 0.5 if i % 2 else (np.arange(12) > 0) & (np.arange(12) < 2 + i % 9)  # scattered, or a range
        tree.feature[k], tree.mask[k] = int(rng.integers(5)), mask
        open_ += [tree.left[k], tree.right[k]]
    tree.depth = 6
    tree = tree.frozen()
    node = np.zeros(n, np.int64)
    for _ in range(8):
        inner = tree.feature[node] >= 0
        left = tree.mask[node, bins[np.maximum(tree.feature[node], 0), np.arange(n)]]
        node = np.where(inner, np.where(left, tree.left[node], tree.right[node]), node)
    assert (tree.places(bins) == node).all() and (tree.places(bins[:, :50]) == node[:50]).all()
    at, some = np.arange(0, n, 3), [tree.left[0], open_[2], open_[-1]]
    rows, place = tree.slots(bins, open_, at)
    assert set(rows) <= set(at) and (node[rows] == np.array(open_)[place]).all() and len(rows) == len(at)
    assert [len(r) for r in tree.rows_at(bins, some[1:], at)] == [(node[at] == k).sum() for k in some[1:]]


def test_counts_of_a_bin_that_most_rows_share():
    rng = np.random.default_rng(8)
    n, nodes, bins = 2 * boosting.MANY_ROWS + 5, 20, 16
    x = rng.integers(0, bins, (3, n)).astype(np.uint8)
    x[0, rng.random(n) < 0.95] = 3
    q, place = rng.integers(-1000, 1000, n).astype(float), rng.integers(0, nodes, n)
    for slot, count in ((None, 1), (place * bins, nodes)):
        want = np.zeros((count, 3, bins, 2), np.int64)
        for k in range(3):
            np.add.at(want, (0 if slot is None else place, k, x[k], 0), q.astype(int))
            np.add.at(want, (0 if slot is None else place, k, x[k], 1), 1)
        assert (boosting._counted(x, q, slot, count, bins) == want).all()


def test_patterns_of_any_number_of_inputs():
    rnd = np.random.default_rng(2)
    for m in (1, 8, 12, 20, 70):
        one = [rnd.random(500) < 0.5 for _ in range(m)]
        found, which = attribution._patterns(one)
        assert (found[which] == np.stack(one, 1)).all() and len(np.unique(found, axis=0)) == len(found)


def test_permutations_ask_only_trees_that_read_the_input(stored_matrix, monkeypatch):
    blocks, binning = stored_matrix
    model = boosting.Ensemble("m", boosting.Rules(step=0.4, rounds=3, leaves=4), ALL)
    boosting.grow(blocks, binning, [model])
    rows = blocks.collect()
    sse, n = np.zeros(4), 0
    for r in rows:  # one input after the other, block by block
        at = [i for i, w in enumerate(r["weeks"]) if ALL[0] <= w <= ALL[1]]
        bins, y = np.frombuffer(r["bins"], np.uint8).reshape(3, -1)[:, at].copy(), np.frombuffer(r["y"])[at]
        rnd, n = np.random.default_rng([42, len(at)]), n + len(at)
        for k in range(3):
            kept = bins[k].copy()
            bins[k] = kept[rnd.permutation(len(at))]
            sse[k] += ((y - model.predict(bins)) ** 2).sum()
            bins[k] = kept
        sse[3] += ((y - model.predict(bins)) ** 2).sum()
    rmse = np.sqrt(sse / n)
    got = {r["feature"]: r["permutation_rmse_increase"] for r in attribution.permutation_errors(blocks, model, ALL, binning.names).collect()}
    assert np.allclose([got[c] for c in binning.names], rmse[:3] - rmse[3], atol=1e-9)


def test_rows_of_large_trees_are_looked_up_in_pieces(monkeypatch):
    rnd = np.random.default_rng(4)
    t = boosting.Tree()
    for _ in range(511):
        t.add(0.0, 1)
    for k in range(255):
        t.feature[k], t.left[k], t.right[k], t.mask[k] = int(rnd.integers(0, 5)), 2 * k + 1, 2 * k + 2, rnd.random(256) < 0.5
    t.depth = 8
    tree, bins = t.frozen(), rnd.integers(0, 256, (5, 10_000)).astype(np.uint8)
    calls, plain = [], boosting.Tree.goes_left
    monkeypatch.setattr(boosting.Tree, "goes_left", lambda *a: calls.append(1) or plain(*a))
    found = tree.places(bins)
    assert not calls
    monkeypatch.setattr(boosting, "MANY_NODES", 1000)
    assert (tree.places(bins) == found).all() and calls


def test_late_ensembles_follow_in_the_same_job(spark, stored_matrix, monkeypatch):
    blocks, binning = stored_matrix
    rules = boosting.Rules(step=0.4, rounds=60, leaves=6, patience=4)
    made = lambda: [boosting.Ensemble("early", rules, ALL, HELD), boosting.Ensemble("late", rules, (ALL[0], HELD[1]))]
    apart, together, in_task = made(), made(), made()
    boosting.grow(blocks, binning, apart[:1], 0)
    apart[1].follow(apart[0])
    boosting.grow(blocks, binning, apart[1:], 0)
    boosting.grow(blocks, binning, in_task, after={1: 0})
    monkeypatch.setattr(boosting, "_pass", None)
    boosting.grow(blocks, binning, together, len(binning.names) * 700 - 1, after={1: 0})
    assert len(apart[0].trees) - 4 == len(apart[1].trees) > 1
    assert all(same(a, b) for a, b in zip(apart + apart, together + in_task))
    parts = boosting._dealt(blocks, 3).rdd.glom().map(lambda rows: sum(len(r["weeks"]) for r in rows)).collect()
    assert len(parts) == 3 and sum(parts) == 700 and max(parts) - min(parts) <= 100
