"""Additive attribution of predictions: path-dependent Shapley values of tree ensembles.

A leaf's share of a prediction is spread over the inputs on its path. An input that the row satisfies
counts as present with weight 1, one that is left out follows the trees' row counts (cover). Over all subsets of
the m inputs of a path the weights form a polynomial, built factor by factor in m steps, so a leaf costs
m^3 and not 2^m. The polynomial depends only on which of the path's inputs a row satisfies, so it is
evaluated once per such pattern and looked up by row.

A row's values and the base (the expected prediction) add up to its prediction. One pass over the stored
matrix; tasks hold a block and the trees.
"""

from __future__ import annotations

from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BLOCK_ROWS, EPOCH, Block, Ensemble, Tree


def leaf_paths(tree: Tree) -> list[tuple[int, list[tuple[int, bool]]]]:
    """Each leaf with its path: inner nodes and whether it goes left there."""
    out, stack = [], [(0, [])]
    while stack:
        node, path = stack.pop()
        if tree.feature[node] < 0:
            out.append((node, path))
        else:
            stack.append((int(tree.left[node]), [*path, (node, True)]))
            stack.append((int(tree.right[node]), [*path, (node, False)]))
    return out


def pattern_values(zero: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """Shapley weights of a leaf of value 1: patterns x inputs. ``zero`` is the cover share of each input's
    conditions, ``patterns`` tells (0 or 1) which inputs satisfy theirs."""
    m = len(zero)
    weight = np.array([factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)])
    out = np.empty((len(patterns), m))
    for i in range(m):
        c = np.zeros((len(patterns), m))
        c[:, 0] = 1
        for j in range(m):
            if j != i:
                shifted = c[:, :-1] * patterns[:, j, None]
                c *= zero[j]
                c[:, 1:] += shifted
        out[:, i] = (c @ weight) * (patterns[:, i] - zero[i])
    return out


def tree_values(tree: Tree, bins: np.ndarray, out: np.ndarray) -> float:
    """Add a tree's values (rows x inputs) to ``out``; returns its expected value."""
    inner = np.flatnonzero(tree.feature >= 0)
    left = {int(k): tree.mask[k, bins[tree.feature[k]]] for k in inner}
    expected = 0.0
    for leaf, path in leaf_paths(tree):
        inputs = list(dict.fromkeys(int(tree.feature[k]) for k, _ in path))
        zero, one = np.ones(len(inputs)), [None] * len(inputs)
        for k, goes_left in path:
            at = inputs.index(int(tree.feature[k]))
            child = tree.left[k] if goes_left else tree.right[k]
            zero[at] *= tree.rows[child] / tree.rows[k]
            here = left[k] if goes_left else ~left[k]
            one[at] = here if one[at] is None else one[at] & here
        expected += tree.value[leaf] * zero.prod()
        if not inputs:
            continue
        patterns, which = _patterns(one)
        table = np.ascontiguousarray(tree.value[leaf] * pattern_values(zero, patterns).T)
        for at, k in enumerate(inputs):  # a column after the other
            out[:, k] += table[at].take(which)
    return expected


def _patterns(one: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct patterns (0 or 1, patterns x inputs) and the place of each row's among them; without a sort up to 16 inputs."""
    m = len(one)
    if m > 62:
        packed = np.packbits(np.stack(one, 1), axis=1, bitorder="little")
        found, which = np.unique(packed, axis=0, return_inverse=True)
        return np.unpackbits(found, axis=1, count=m, bitorder="little").astype(np.float64), which.reshape(-1)
    kind = np.uint8 if m <= 8 else np.uint16 if m <= 16 else np.int64
    codes = np.zeros(len(one[0]), kind)
    for k, here in enumerate(one):
        codes |= np.left_shift(here.astype(kind), kind(k))
    if m <= 16:
        seen = np.zeros(1 << m, bool)
        seen[codes] = True
        found, which = np.flatnonzero(seen), (np.cumsum(seen) - 1).take(codes)
    else:
        found, which = np.unique(codes, return_inverse=True)
    return (found[:, None] >> np.arange(m) & 1).astype(np.float64), which


def ensemble_values(ensemble: Ensemble, bins: np.ndarray) -> tuple[float, np.ndarray]:
    """Base and values (rows x inputs) of an ensemble."""
    out = np.zeros(bins.shape).T  # columns are filled one by one
    base = ensemble.base
    for tree in ensemble.trees:
        base += tree_values(tree, bins, out)
    return base, out


def attributed(batches, ensemble: Ensemble, days: tuple[int, int], features: int):
    """Batches of :func:`attributions`. A leaf's weights cost the same for few rows as for many, and a block has few rows of
    a range of days, so rows of several blocks are worked on at once."""
    held, size = [], 0

    def values_of(held):
        products, weeks, bins = zip(*held)
        bins = np.ascontiguousarray(np.concatenate(bins, axis=1))
        base, values = ensemble_values(ensemble, bins)
        n = bins.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * features, pa.int32()), pa.array(values.ravel()))
        return pa.RecordBatch.from_arrays([
            pa.concat_arrays(products), pa.array(np.concatenate(weeks)), pa.array(np.full(n, base)), pa.array(ensemble.predict(bins)), lists],
            names=["ProductID", "week", "base", "y_pred", "values"])

    for batch in batches:
        for i in range(batch.num_rows):
            block = Block(batch, i, features)
            at = block.within(days)
            if not len(at):
                continue
            held.append((batch.column("products")[i].values.take(pa.array(at)), block.weeks[at], block.bins[:, at]))
            size += len(at)
            if size >= BLOCK_ROWS:
                yield values_of(held)
                held, size = [], 0
    if held:
        yield values_of(held)


def attributions(blocks: DataFrame, ensemble: Ensemble, days: tuple[int, int], features: int) -> DataFrame:
    """``ProductID, WeekStart, base, y_pred, values`` (one per input) of the rows of a range of days."""

    def run(batches):
        yield from attributed(batches, ensemble, days, features)

    rows = blocks.select("products", "weeks", "y", "bins", F.lit(b"").alias("f"), F.lit(0).alias("ensembles")).mapInArrow(
        run, "ProductID string, week int, base double, y_pred double, values array<double>")
    return rows.select("ProductID", F.date_add(F.lit(EPOCH), F.col("week")).alias("WeekStart"), "base", "y_pred", "values")


def mean_absolute(values: DataFrame, names: list[str]) -> DataFrame:
    """``feature, mean_abs_attribution`` over the rows of :func:`attributions`."""
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1)
    return values.select(F.posexplode("values").alias("i", "v")).groupBy(label.alias("feature")).agg(
        F.avg(F.abs("v")).alias("mean_abs_attribution"))


def permutation_errors(blocks: DataFrame, ensemble: Ensemble, days: tuple[int, int], names: list[str], seed: int = 42) -> DataFrame:
    """``feature, permutation_rmse_increase``: how much the RMSE over a range of days grows when one input's
    values are dealt out anew among the rows of each block. One pass, no rows move; rows of several blocks are worked on
    at once, and only trees that ask for an input are asked again."""
    features = len(names)

    def errors(held):
        y, bins, dealt = np.concatenate([y for y, _, _ in held]), *(np.concatenate(x, axis=1) for x in list(zip(*held))[1:])
        predicted, change = np.full(len(y), ensemble.base), np.zeros((features, len(y)))
        for tree in ensemble.trees:
            value = tree.value[tree.places(bins)]
            predicted += value
            for k in np.unique(tree.feature[tree.feature >= 0]):
                kept = bins[k].copy()
                bins[k] = dealt[k]
                change[k] += tree.value[tree.places(bins)] - value
                bins[k] = kept
        rest = y - predicted
        return np.array([*[((rest - x) ** 2).sum() for x in change], (rest ** 2).sum()])

    def run(batches):
        sums, n, held, size = np.zeros(features + 1), 0, [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch, i, features)
                at = block.within(days)
                bins, rnd = block.bins[:, at], np.random.default_rng([seed, len(at)])
                held.append((block.y[at], bins, np.stack([x[rnd.permutation(len(at))] for x in bins])))
                n, size = n + len(at), size + len(at)
                if size >= BLOCK_ROWS:
                    sums, held, size = sums + errors(held), [], 0
        if held:
            sums = sums + errors(held)
        yield pa.RecordBatch.from_arrays([pa.array(range(features + 1), pa.int32()), pa.array(sums), pa.array([n] * (features + 1), pa.int64())],
                                         names=["i", "sse", "n"])

    errors = blocks.select("products", "weeks", "y", "bins", F.lit(b"").alias("f"), F.lit(0).alias("ensembles")).mapInArrow(
        run, "i int, sse double, n bigint").groupBy("i").agg(F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse")).collect()
    found = {r["i"]: r["rmse"] for r in errors}  # one row per input
    out = [(c, float(found[k] - found[features])) for k, c in enumerate(names) if found.get(features) is not None]
    return blocks.sparkSession.createDataFrame(out, "feature string, permutation_rmse_increase double")
