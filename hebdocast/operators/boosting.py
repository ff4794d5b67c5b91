"""Histogram gradient boosting over a stored matrix of bins, for squared loss.

Inputs are cut into at most 256 bins, bin 0 for unknown values, and stored once as blocks of rows
(feature-major bytes). Trees grow from histograms of residuals per (leaf, feature, bin): one pass of the
tasks over the blocks and one aggregate. Of two new leaves only the smaller one is counted, its sibling
is the difference to the parent. The leaf queue is on the driver, which sees nothing but histograms
(leaves x features x bins) and trees.

Growth: *best-first* up to ``leaves`` leaves (the leaf of the largest gain is split next), or *by level* to
``depth``. A pass counts all leaves that may be among the next splits, so a tree of 63 leaves takes about
eight passes and not 62; leaves that turn out not to be among the best are given up again, so the tree is the
one that splitting them one by one gives. Several ensembles (two models, two histories) grow in lockstep and
share their passes.

Ensembles are resumable: predictions follow from the trees. They stay beside the bins, and a round adds its tree to
them once; every ``STORE`` rounds they are stored, so neither growing on nor a lost task starts anew. Residuals enter histograms as integers of 20 bits, so sums don't
depend on the order or place of tasks, and a lost task gives the same tree again.

A job per pass costs more than its counting, so where parts of the matrix fit the running tasks (its bytes are counted
first) growth takes one job, by the same rule and with the same trees. A matrix of at most ``in_task_bytes`` is read by a
task of each ensemble. A larger one is dealt out once to tasks that run side by side (a barrier stage): each counts its own
rows, all get the counts of all, a few bytes a cell, and grow the same trees from their sums. What doesn't fit there goes by passes.

Unknown values go to the side that gains more. Categories are ordered by their smoothed mean residual, and
every prefix of that order is a candidate split. Splits are byte masks over bins for both kinds.
"""

from __future__ import annotations

import base64
import dataclasses
import datetime as _dt
import heapq
import os
import pickle
import time
import uuid
import zlib
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch, stored

BLOCK_ROWS = 65_536
STORE = 16  # rounds between two stored prediction columns
BITS = 20  # of a residual in a histogram
MANY_ROWS = 4_096  # rows from which a block is worked on as a whole
IN_TASK_BYTES = 1 << 26  # stored bins up to which each ensemble grows in one task; beyond it, by passes
MANY_NODES = 192  # of a tree, beyond which rows are looked up rather than asked at every node
MANY_JOINT = 16_384  # rows from which inputs are counted several at once
CELLS = 1 << 14  # of inputs that are counted at once
PIECE = 1 << 16  # rows that are looked up and counted at once
MOST_JOINT = 1 << 20  # rows that are summed up by cell before the sums of each input follow
POINTS = 1 << 15  # of a quantile summary
SUMMED_ROWS = 1 << 20  # rows that a task sums up at once
TOGETHER = 32  # tasks at most that grow side by side: each reads the counts of all
SHARE = 4  # times IN_TASK_BYTES that a task holds of a matrix that tasks share
_COUNT = float(1 << (BITS + 17))  # a row, in sums that hold rows and residuals in one number
SMOOTH = 10.0  # rows added to a category's mean when categories are ordered
EPOCH = _dt.date(1970, 1, 1)


def day(date: _dt.date) -> int:
    return (date - EPOCH).days


@dataclasses.dataclass(frozen=True)
class Rules:
    """How an ensemble grows. ``leaves`` for best-first growth, else ``depth`` levels."""

    step: float
    rounds: int
    leaves: int | None = None
    depth: int | None = None
    min_rows: int = 20
    l2: float = 0.0
    patience: int | None = None


class Tree:
    """Flat arrays of a tree: feature (-1 at a leaf), children, bins that go left, value and rows of each node."""

    def __init__(self):
        self.feature, self.left, self.right, self.value, self.rows, self.gain = [], [], [], [], [], []
        self.mask: list[np.ndarray] = []
        self.depth = 0

    def add(self, value: float, rows: int) -> int:
        self.feature.append(-1)
        self.left.append(-1)
        self.right.append(-1)
        self.value.append(value)
        self.rows.append(rows)
        self.gain.append(0.0)
        self.mask.append(np.zeros(256, bool))
        return len(self.feature) - 1

    def frozen(self) -> "Tree":
        """The same tree over arrays, as tasks get it."""
        out = Tree.__new__(Tree)
        for name, kind in (("feature", np.int64), ("left", np.int64), ("right", np.int64), ("value", np.float64),
                           ("rows", np.int64), ("gain", np.float64)):
            setattr(out, name, np.array(getattr(self, name), kind))
        out.mask, out.depth = np.array(self.mask, bool).reshape(-1, 256), self.depth
        out.first, out.last = out.mask.argmax(1), 255 - out.mask[:, ::-1].argmax(1)
        out.last[out.mask.sum(1) != out.last - out.first + 1] = -1  # bins that aren't one range
        return out

    def goes_left(self, k: int, bins: np.ndarray) -> np.ndarray:
        """Which of the rows go left at a node. A range of bins is compared byte by byte, without a table."""
        cells = bins[self.feature[k]]
        if self.last[k] < 0:
            return self.mask[k].take(cells)
        return cells - np.uint8(self.first[k]) <= np.uint8(self.last[k] - self.first[k])

    def places(self, bins: np.ndarray) -> np.ndarray:
        """Node that each row (a column of ``bins``) ends in."""
        n = bins.shape[1]
        if n > MANY_ROWS and len(self.feature) > MANY_NODES:
            return np.concatenate([self.places(bins[:, i:i + MANY_ROWS - 1]) for i in range(0, n, MANY_ROWS - 1)])
        if n >= MANY_ROWS and len(self.feature) <= MANY_NODES:  # all rows are asked at every node, in bytes: no row is looked up by its number
            node, here = np.zeros(n, np.uint16), {0: np.ones(n, bool)}
            for k in range(len(self.feature)):  # a node has a larger number than its parent
                rows = here.pop(k)
                if self.feature[k] < 0:
                    node |= np.multiply(rows, np.uint16(k), dtype=np.uint16)
                    continue
                left = self.goes_left(k, bins)
                left &= rows
                here[int(self.left[k])], here[int(self.right[k])] = left, rows ^ left
            return node
        cells, mask = bins.ravel(), self.mask.ravel()
        node = np.zeros(n, np.int64)
        at, k = np.arange(n), node.copy()
        for _ in range(self.depth):
            feature = self.feature.take(k)
            if (feature < 0).any():  # rows that are at a leaf stay there
                inner = np.flatnonzero(feature >= 0)
                at, k, feature = at.take(inner), k.take(inner), feature.take(inner)
            left = mask.take(k * 256 + cells.take(feature * n + at))
            k = np.where(left, self.left.take(k), self.right.take(k))
            node[at] = k
        return node


    def slots(self, bins: np.ndarray, nodes: list[int], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the rows ``at`` (columns of ``bins``) that are at one of ``nodes``, and the place of that node in
        the list. Only paths to these nodes are followed; at each, all rows of the block are asked, in bytes."""
        parent = np.full(len(self.feature), -1, np.int64)
        for k in np.flatnonzero(self.feature >= 0):
            parent[self.left[k]] = parent[self.right[k]] = k
        wanted, place = {0, *nodes}, {k: i + 1 for i, k in enumerate(nodes)}
        for k in nodes:
            while parent[k] >= 0 and int(parent[k]) not in wanted:
                k = int(parent[k])
                wanted.add(k)
        asked = np.zeros(bins.shape[1], bool)
        asked[at] = True
        here, found = {0: asked}, np.zeros(bins.shape[1], np.uint16)
        for k in sorted(wanted):  # a node has a larger number than its parent
            rows = here.pop(k)
            if k in place:
                found |= np.multiply(rows, np.uint16(place[k]), dtype=np.uint16)
            children = int(self.left[k]), int(self.right[k])
            if self.feature[k] < 0 or wanted.isdisjoint(children):
                continue
            left = self.goes_left(k, bins)
            left &= rows
            if children[0] in wanted:
                here[children[0]] = left
            if children[1] in wanted:
                here[children[1]] = rows ^ left
        rows = np.flatnonzero(found)
        return rows, found.take(rows).astype(np.int64) - 1

    def rows_at(self, bins: np.ndarray, nodes: list[int], at: np.ndarray) -> list[np.ndarray]:
        """Of the rows ``at``, those at each of ``nodes``."""
        rows, place = self.slots(bins, nodes, at)
        return [rows[place == i] for i in range(len(nodes))]


@dataclasses.dataclass
class Split:
    gain: float
    feature: int
    mask: np.ndarray
    left: tuple[int, int]  # sum and rows
    right: tuple[int, int]


def best_splits(hists: list[np.ndarray], nominal: np.ndarray, rules: Rules) -> list[Split | None]:
    """The split of each leaf with the largest gain, from its histogram (features x bins x (sum, rows)); ties go to
    the first feature, then the fewest bins to the left, then unknown values to the right."""
    if not hists:
        return []
    hist = np.stack(hists)
    leaves, features, bins, _ = hist.shape
    g, n = hist[..., 0].astype(np.float64), hist[..., 1].astype(np.float64)
    total_g, total_n = g[:, 0].sum(1)[:, None, None], n[:, 0].sum(1)[:, None, None]
    cg, cn = g[..., 1:].copy(), n[..., 1:].copy()
    at = np.flatnonzero(nominal)
    if len(at):
        mean = np.where(n[:, at, 1:] > 0, g[:, at, 1:] / (n[:, at, 1:] + SMOOTH), np.inf)  # unseen categories come last
        order = np.argsort(mean, axis=2, kind="stable")
        cg[:, at], cn[:, at] = np.take_along_axis(cg[:, at], order, 2), np.take_along_axis(cn[:, at], order, 2)
    np.cumsum(cg, 2, out=cg)
    np.cumsum(cn, 2, out=cn)

    def score(sums, rows):
        return sums * sums / np.maximum(rows + rules.l2, 1e-300)

    parent = score(total_g, total_n)
    gains = np.full((leaves, features, bins - 1, 2), -np.inf)
    for missing_left in (0, 1):
        lg, ln = cg + g[..., :1] * missing_left, cn + n[..., :1] * missing_left
        rn = total_n - ln
        gain = score(lg, ln) + score(total_g - lg, rn) - parent
        fine = (ln >= rules.min_rows) & (rn >= rules.min_rows) & (ln > 0) & (rn > 0)
        if missing_left:
            fine &= n[..., :1] > 0
        gains[..., missing_left] = np.where(fine, gain, -np.inf)
    out: list[Split | None] = []
    flat = gains.reshape(leaves, -1)
    for leaf, where in enumerate(flat.argmax(1).tolist()):
        best = float(flat[leaf, where])
        if not best > 1e-9 * abs(float(parent[leaf, 0, 0])):
            out.append(None)
            continue
        feature, cut, missing_left = (int(x) for x in np.unravel_index(where, gains.shape[1:]))
        mask = np.zeros(256, bool)
        if nominal[feature]:
            first = order[leaf, np.flatnonzero(at == feature)[0], :cut + 1] + 1
            mask[first[n[leaf, feature, first] > 0]] = True
        else:
            mask[1:cut + 2] = True
        mask[0] = bool(missing_left)
        left = hist[leaf, feature, mask[:bins]].sum(0)
        right = hist[leaf, feature].sum(0) - left
        out.append(Split(best, feature, mask, tuple(left.tolist()), tuple(right.tolist())))
    return out


class Ensemble:
    """Trees of one model, and the state that it needs to grow on."""

    def __init__(self, name: str, rules: Rules, fit: tuple[int, int], held: tuple[int, int] | None = None):
        """``fit`` and ``held`` are ranges of days (first, last) of the rows to fit and to measure the loss on."""
        self.name, self.rules, self.fit, self.held = name, rules, fit, held
        self.base = 0.0
        self.scale = 1.0
        self.trees: list[Tree] = []
        self.losses: list[float] = []

    def truncated(self, rounds: int) -> "Ensemble":
        out = Ensemble(self.name, self.rules, self.fit, self.held)
        out.base, out.scale, out.trees = self.base, self.scale, self.trees[:rounds]
        return out

    def follow(self, leader: "Ensemble") -> None:
        """Take as many rounds as early stopping of ``leader`` has found best."""
        self.rules = dataclasses.replace(self.rules, rounds=leader.best()[0] if leader.losses else 0, patience=None)

    def predict(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(bins.shape[1], self.base)
        for t in self.trees:
            out += t.value[t.places(bins)]
        return out

    def best(self) -> tuple[int, bool]:
        """Round of the smallest loss before ``patience`` rounds brought no better one, and whether that stop came."""
        return best_round(self.losses, self.rules.patience or len(self.losses) + 1)

    def growing(self, nominal: np.ndarray):
        """Generator: yields ``(partial tree or None, nodes to count)`` and is sent ``(histograms by node, loss)``."""
        while True:
            hist, loss = yield None, [0]
            if self.held is not None and self.trees:
                self.losses.append(loss)
                if self.rules.patience and self.best()[1]:
                    return
            if len(self.trees) >= self.rules.rounds:
                return
            tree = yield from self._tree(hist[0], nominal)
            self.trees.append(tree.frozen())

    def _tree(self, root: np.ndarray, nominal: np.ndarray):
        rules, tree = self.rules, Tree()
        value = lambda g, n: rules.step * g / (n + rules.l2) / self.scale if n else 0.0
        hist = {tree.add(value(int(root[0, :, 0].sum()), int(root[0, :, 1].sum())), int(root[0, :, 1].sum())): root}
        split = {0: best_splits([root], nominal, rules)[0]}
        level = {0: 0}
        children: dict[int, tuple[int, int]] = {}

        def part(node: int) -> tuple[int, int]:
            s = split[node]
            a, b = tree.add(value(*s.left), s.left[1]), tree.add(value(*s.right), s.right[1])
            children[node] = a, b
            level[a] = level[b] = level[node] + 1
            tree.feature[node], tree.mask[node], tree.gain[node] = s.feature, s.mask, s.gain
            tree.left[node], tree.right[node] = a, b
            tree.depth = max(tree.depth, level[a])
            return a, b

        while True:
            if rules.leaves is None:
                wanted = [k for k in list(split) if k not in children and split[k] is not None and level[k] < rules.depth]
                for k in wanted:
                    part(k)
                # children of the last level need no histogram: their sums are known
                wanted = [k for k in wanted if level[k] + 1 < rules.depth]
                if not wanted:
                    return tree
            else:
                popped, open_, last = self._popped(split, children)
                if last:  # the last split is certain, and its leaves need no histogram
                    part(open_.pop())
                    popped.append(last[0])
                if not open_:
                    return _pruned(tree, popped, children)
                for k in open_:
                    part(k)
                wanted = open_
            count = [min(children[k], key=lambda c: (tree.rows[c], c)) for k in wanted]
            found, _ = yield tree.frozen(), count
            for k, small in zip(wanted, count):
                a, b = children[k]
                large = b if small == a else a
                hist[small], hist[large] = found[small], hist.pop(k) - found[small]
            new = [c for k in wanted for c in children[k]]
            able = [c for c in new if tree.rows[c] >= 2 * rules.min_rows]
            split.update(dict.fromkeys(new))
            split.update(zip(able, best_splits([hist[c] for c in able], nominal, rules)))

    def _popped(self, split, children) -> tuple[list[int], list[int], list[int]]:
        """Nodes in the order in which best-first growth splits them, as far as known; the nodes whose children
        must be counted before that order is certain (none: the tree is complete); and, if it is certain that
        the only one of those is the last split, that node."""
        queue = [(-split[0].gain, 0)] if split[0] else []
        popped, open_, k = [], [], 0
        while queue and len(popped) + len(open_) < self.rules.leaves - 1:
            _, k = heapq.heappop(queue)
            if k not in children:
                open_.append(k)
                continue
            popped.append(k)
            for c in children[k]:
                if split.get(c):
                    heapq.heappush(queue, (-split[c].gain, c))
        certain = open_ == [k] and len(popped) + 1 == self.rules.leaves - 1
        return popped, open_, open_[:] if certain else []


def _pruned(tree: Tree, popped: list[int], children) -> Tree:
    """The tree of the popped splits alone."""
    out, new = Tree(), {}
    kept = set(popped)
    stack = [(0, 0)]
    new[0] = out.add(tree.value[0], tree.rows[0])
    while stack:
        k, level = stack.pop()
        out.depth = max(out.depth, level)
        if k not in kept:
            continue
        for c in children[k]:
            new[c] = out.add(tree.value[c], tree.rows[c])
            stack.append((c, level + 1))
        at = new[k]
        out.feature[at], out.mask[at], out.gain[at] = tree.feature[k], tree.mask[k], tree.gain[k]
        out.left[at], out.right[at] = (new[c] for c in children[k])
    return out


_ROOT = Tree()
_ROOT.add(0.0, 0)


def best_round(losses: list[float], patience: int) -> tuple[int, bool]:
    """Round of the smallest loss before ``patience`` rounds passed without a better one, and whether
    that stop was reached."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


# --- bins ----------------------------------------------------------------------------------
@dataclasses.dataclass(frozen=True)
class Binning:
    """Cut points of each numeric input, and the names of nominal inputs, whose values are codes from 0."""

    numeric: tuple[str, ...]
    nominal: tuple[str, ...]
    cuts: tuple[tuple[float, ...], ...]
    codes: tuple[int, ...]  # number of codes of each nominal input

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *self.nominal]

    @property
    def is_nominal(self) -> np.ndarray:
        return np.array([False] * len(self.numeric) + [True] * len(self.nominal))

    @property
    def widths(self) -> list[int]:
        """Bins of each input."""
        return [*(len(c) + 2 for c in self.cuts), *(min(c, 255) + 1 for c in self.codes)]

    @property
    def bins(self) -> int:
        """Bins of the widest input."""
        return max([2, *self.widths])

    def apply(self, columns: list[np.ndarray]) -> np.ndarray:
        """Bins of float columns (NaN: unknown), inputs x rows. Codes past 254 share the last bin."""
        out = np.zeros((len(columns), len(columns[0]) if columns else 0), np.uint8)
        for k, x in enumerate(columns):
            known = ~np.isnan(x)
            if k < len(self.numeric):
                out[k, known] = 1 + np.searchsorted(self.cuts[k], x[known], side="left")
            else:
                out[k, known] = 1 + np.minimum(x[known], 254)
        return out


def fit_binning(df: DataFrame, numeric: list[str], nominal: dict[str, int], max_bins: int = 128, rows=None) -> Binning:
    """Cut points from mergeable quantile summaries: half of them over all values, half over those that aren't 0, so that
    columns that are mostly 0 keep bins for the rest. A task sums up its rows by column, then a column's summaries meet.
    With ``rows`` tasks make the rows of the batches of ``df``: it yields batches with the inputs as ``x0`` and so on."""
    half = max(1, (max_bins - 2) // 2)
    shares = np.linspace(0, 1, half + 1)[:-1]

    def run(batches):
        zeros, held = np.zeros(len(numeric), np.int64), [(np.zeros(0), np.zeros(0, np.int64))] * len(numeric)
        waiting, size = [[] for _ in numeric], 0
        for batch in rows(batches) if rows else batches:
            size += batch.num_rows
            for k, parts in enumerate(waiting):
                x = batch.column(f"x{k}").drop_null().to_numpy(zero_copy_only=False)
                other = x[x != 0]
                zeros[k] += len(x) - len(other)
                parts.append(other[~np.isnan(other)])
            if size >= SUMMED_ROWS:
                held, waiting, size = [_summary(*h, *_distinct(w)) for h, w in zip(held, waiting)], [[] for _ in numeric], 0
        held = [_summary(*h, *_distinct(w)) for h, w in zip(held, waiting)]
        yield pa.RecordBatch.from_arrays([
            pa.array(range(len(numeric)), pa.int32()), pa.array(zeros, pa.int64()), pa.array([v.tobytes() for v, _ in held], pa.binary()),
            pa.array([n.tobytes() for _, n in held], pa.binary())], names=["k", "zeros", "points", "counts"])

    def cut(table: pa.Table) -> pa.Table:
        points, counts = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()])
                          for c, t in (("points", np.float64), ("counts", np.int64)))
        other = _merged(points, counts)
        every = _merged(np.append(points, 0.0), np.append(counts, sum(table.column("zeros").to_pylist())))
        found = sorted({*_at_shares(*every, shares), *_at_shares(*other, shares)})
        return pa.table({"k": table.column("k").slice(0, 1), "cuts": pa.array([found], pa.list_(pa.float64()))})

    narrow = df if rows else df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{k}") for k, c in enumerate(numeric)])
    found = narrow.mapInArrow(run, "k int, zeros bigint, points binary, counts binary").groupBy("k").applyInArrow(
        cut, "k int, cuts array<double>").collect() if numeric else []
    cuts = {r["k"]: tuple(r["cuts"]) for r in found}
    return Binning(tuple(numeric), tuple(nominal), tuple(cuts.get(k, ()) for k in range(len(numeric))), tuple(nominal.values()))


def _distinct(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([np.zeros(0), *parts]), return_counts=True)


def _merged(points: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points in order and how many values they stand for."""
    order = np.argsort(points, kind="stable")
    return points[order], counts[order]


def _summary(points: np.ndarray, counts: np.ndarray, more: np.ndarray, more_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two summaries as one of at most ``POINTS`` points, each standing for the values up to it. Fewer distinct values
    stay as they are; else ranks shift by at most a share of 1/POINTS."""
    points, counts = _merged(np.append(points, more), np.append(counts, more_counts))
    if len(points) <= POINTS:
        return points, counts
    total = np.cumsum(counts)
    last = np.unique(np.searchsorted(total, np.ceil(np.arange(1, POINTS + 1) * (total[-1] / POINTS)).clip(max=total[-1])))
    return points[last], np.diff(total[last], prepend=0)


def _at_shares(points: np.ndarray, counts: np.ndarray, shares: np.ndarray) -> list[float]:
    """The values that shares of all values don't exceed."""
    total = np.cumsum(counts)
    if not len(total) or not total[-1]:
        return []
    return points[np.searchsorted(total, np.maximum(1, np.ceil(shares * total[-1])))].tolist()


STATE = "weeks array<int>, y binary, bins binary, f binary, ensembles int"  # what passes read
BLOCK = f"products array<string>, {STATE}"


def matrix(df: DataFrame, binning: Binning, *, id_col: str = "ProductID", week_col: str = "WeekStart",
           y_col: str = "Sales_Qty", rows: int = BLOCK_ROWS, made=None) -> DataFrame:
    """The stored matrix: one row per block of at most ``rows`` rows. Nominal inputs come as ``<name>_code``. With ``made`` tasks
    make the rows of the batches of ``df``: it yields batches of ``id, week, y`` and the inputs as ``x0`` and so on."""
    inputs = [F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate([*binning.numeric, *[f"{c}_code" for c in binning.nominal]])]
    width = len(inputs)

    def run(batches):
        held, size = [], 0
        for batch in made(batches) if made else batches:
            held.append(batch)
            size += batch.num_rows
            if size >= rows:
                yield from blocks(held)
                held, size = [], 0
        yield from blocks(held)

    def blocks(held):
        table = pa.Table.from_batches(held).combine_chunks() if held else None
        for at in range(0, table.num_rows if table else 0, rows):
            part = table.slice(at, rows).combine_chunks()
            columns = [part.column(f"x{i}").to_numpy() for i in range(width)]
            y = part.column("y").to_numpy().astype(np.float64)
            yield pa.RecordBatch.from_arrays([
                *[pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c).combine_chunks()) for c in ("id", "week")],
                pa.array([y.tobytes()], pa.binary()), pa.array([binning.apply(columns).tobytes()], pa.binary()),
                pa.array([b""], pa.binary()), pa.array([0], pa.int32())],
                names=["products", "weeks", "y", "bins", "f", "ensembles"])

    week = F.datediff(F.col(f"`{week_col}`"), F.lit(EPOCH)).alias("week")
    narrow = df if made else df.select(
        F.col(f"`{id_col}`").cast("string").alias("id"), week, F.col(f"`{y_col}`").cast("double").alias("y"), *inputs)
    return stored(narrow.mapInArrow(run, BLOCK), "matrix")


class Block:
    """One block in a task."""

    def __init__(self, batch: pa.RecordBatch, i: int, features: int):
        self.y = np.frombuffer(batch.column("y")[i].as_buffer(), np.float64)
        self.bins = np.frombuffer(batch.column("bins")[i].as_buffer(), np.uint8).reshape(features, len(self.y))
        self.weeks = batch.column("weeks")[i].values.to_numpy()
        n = batch.column("ensembles")[i].as_py()
        self.f = np.frombuffer(batch.column("f")[i].as_buffer(), np.float64).reshape(n, len(self.y)) if n else None

    def within(self, days: tuple[int, int]) -> np.ndarray:
        return np.flatnonzero((self.weeks >= days[0]) & (self.weeks <= days[1]))


# --- passes ----------------------------------------------------------------------------------
@dataclasses.dataclass
class Ask:
    """What a pass counts for one ensemble."""

    place: int  # of its stored predictions
    base: float
    scale: float
    since: list[Tree]  # trees after the stored predictions
    fit: tuple[int, int]
    held: tuple[int, int] | None
    tree: Tree | None
    nodes: list[int]

    def predicted(self, block: Block) -> np.ndarray:
        out = block.f[self.place].copy() if block.f is not None else np.full(len(block.y), self.base)
        for t in self.since:
            out += t.value[t.places(block.bins)]
        return out


def _counted(bins_: np.ndarray, q: np.ndarray, slot: np.ndarray | None, nodes: int, bins: int) -> np.ndarray:
    """Sums and rows by (node, feature, bin) of integer residuals ``q``. ``slot`` is each row's node times ``bins``.
    One number holds both: rows in its high bits, residuals in its low ones, exact for a block of rows."""
    features, n = bins_.shape
    out = np.zeros((nodes, features, bins, 2), np.int64)
    offsets = (np.arange(features) * (nodes * bins))[:, None]
    for at in range(0, n, BLOCK_ROWS):
        part = slice(at, at + BLOCK_ROWS)
        weight = q[part] + _COUNT
        if len(weight) < MANY_ROWS:  # few rows: all features at once
            cell = bins_[:, part] + (offsets if slot is None else offsets + slot[part])
            both = np.bincount(cell.ravel(), np.tile(weight, features), features * nodes * bins).reshape(features, nodes, bins)
        else:
            # neighbours (weeks of a product) mostly share a cell, whose sum would wait for the one before: they take turns
            # with several tables, added up behind
            lanes = 4 if nodes <= 16 else 2
            cell = np.arange(len(weight)) % lanes * (nodes * bins) + (0 if slot is None else slot[part])
            both = np.stack([np.bincount(cell + x, weight, lanes * nodes * bins).reshape(lanes, nodes, bins).sum(0)
                             for x in bins_[:, part]])
        both = both.transpose(1, 0, 2)
        rows = np.rint(both / _COUNT)
        out[..., 1] += rows.astype(np.int64)
        out[..., 0] += (both - rows * _COUNT).astype(np.int64)
    return out


def _loss(rest: np.ndarray, scale: float) -> tuple[int, int]:
    """Sum of the squared integer residuals, and rows."""
    q = np.rint(rest * scale).astype(np.int64)
    return int((q * q).sum()), len(rest)


def _mean_loss(total: int, rows: int, scale: float) -> float:
    return float(total) / scale ** 2 / rows if rows else float("nan")


def _histograms(asks: list[Ask], features: int, bins: int):
    """Function for ``mapInArrow``: a row per (ensemble, counted node) with the sums and rows of its cells, one integer after
    another; node -1 has the held-back loss."""

    def count(ask: Ask, block: Block, hist: np.ndarray, loss: list) -> None:
        rest = block.y - ask.predicted(block)
        if ask.held is not None and ask.tree is None:
            held = _loss(rest[block.within(ask.held)], ask.scale)
            loss[0], loss[1] = loss[0] + held[0], loss[1] + held[1]
        at, slot = block.within(ask.fit), None
        if ask.tree is not None:
            at, place = ask.tree.slots(block.bins, ask.nodes, at)
            slot = place * bins
        whole = ask.tree is None and len(at) == len(block.y)
        matrix_ = block.bins if whole else np.take(block.bins, at, axis=1)
        hist += _counted(matrix_, np.rint((rest if whole else rest[at]) * ask.scale), slot, len(ask.nodes), bins)

    def run(batches):
        hist = [np.zeros((len(a.nodes), features, bins, 2), np.int64) for a in asks]
        loss = [[0, 0] for _ in asks]
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch, i, features)
                for e, ask in enumerate(asks):
                    count(ask, block, hist[e], loss[e])
        found = []
        for e, ask in enumerate(asks):
            found += [(e, i, hist[e][i]) for i in range(len(ask.nodes)) if hist[e][i, 0, :, 1].any()]
            # the loss may exceed a long once it is summed: two halves
            found.append((e, -1, np.array([loss[e][0] & 0x7FFFFFFF, loss[e][0] >> 31, loss[e][1]], np.int64)))
        yield _node_batch(found)

    return run


def _pass(state: DataFrame, asks: list[Ask], features: int, bins: int) -> list[tuple[dict[int, np.ndarray], float]]:
    """Histograms by node and mean held-back loss of every ensemble."""
    rows = state.mapInArrow(_histograms(asks, features, bins), NODE).groupBy("e", "node").applyInArrow(_summed, NODE).toArrow()
    sums = {(e, i): np.frombuffer(x, np.int64) for e, i, x in zip(*(rows.column(c).to_pylist() for c in ("e", "node", "sums")))}
    shape, nothing = (features, bins, 2), np.zeros(features * bins * 2, np.int64)
    out = []
    for k, ask in enumerate(asks):
        low, high, n = sums.get((k, -1), (0, 0, 0))
        out.append(({node: sums.get((k, i), nothing).reshape(shape) for i, node in enumerate(ask.nodes)},
                    _mean_loss(int(low) + (int(high) << 31), int(n), ask.scale)))
    return out


NODE = "e int, node int, sums binary"


def _node_batch(found: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e for e, _, _ in found], pa.int32()), pa.array([i for _, i, _ in found], pa.int32()),
                                       pa.array([x.tobytes() for _, _, x in found], pa.binary())], names=["e", "node", "sums"])


def _summed(table: pa.Table) -> pa.Table:
    """The sums of a node over all tasks."""
    total = None
    for x in table.column("sums").to_pylist():
        total = np.frombuffer(x, np.int64).copy() if total is None else total + np.frombuffer(x, np.int64)
    return pa.Table.from_batches([_node_batch([(table.column("e")[0].as_py(), table.column("node")[0].as_py(), total)])])


def grow(blocks: DataFrame, binning: Binning, ensembles: list[Ensemble], in_task_bytes: int = IN_TASK_BYTES,
         after: dict[int, int] | None = None) -> None:
    """Grow the ensembles until each has its rounds or its patience is spent. Ensembles that have trees already
    grow on from them. ``after``: places of ensembles that start when another one has stopped, with its best number of rounds."""
    features, bins, nominal, after = len(binning.names), binning.bins, binning.is_nominal, after or {}
    size = _start(blocks, [e for e in ensembles if not e.trees]) * features
    if in_task_bytes < size <= SHARE * in_task_bytes * (tasks := min(TOGETHER, _slots(blocks.sparkSession))):
        _grow_together(blocks, ensembles, features, bins, binning.widths, nominal, tasks, after)
        return
    for late in (False, True):
        some = [e for k, e in enumerate(ensembles) if (k in after) == late]
        for k, leader in after.items() if late else ():
            ensembles[k].follow(ensembles[leader])
        if some and size <= in_task_bytes:
            _grow_in_tasks(blocks, some, features, bins, binning.widths, nominal)
        elif some:
            _grow_by_passes(blocks, some, features, bins, nominal)


def _grow_by_passes(blocks: DataFrame, ensembles: list[Ensemble], features: int, bins: int, nominal: np.ndarray) -> None:
    """In lockstep: a pass counts what all ensembles ask for."""
    first = blocks.select("weeks", "y", "bins", "f", "ensembles").persist()
    state, since, former = first, [0] * len(ensembles), []
    growing = {k: e.growing(nominal) for k, e in enumerate(ensembles)}
    asked = {k: next(g) for k, g in growing.items()}
    kept = 0  # rounds that only memory holds
    try:
        with _PlainPlans(blocks.sparkSession, blocks.rdd.getNumPartitions()):
            while asked:
                if any(len(ensembles[k].trees) > since[k] and asked[k][0] is None for k in asked):
                    new, kept = _advanced(state, ensembles, since, features), kept + 1
                    former.append(state)
                    if kept >= STORE:
                        new, kept = stored(new, "predictions"), 0
                    state, since = new.persist(), [len(e.trees) for e in ensembles]
                asks = [Ask(k, e.base, e.scale, e.trees[since[k]:], e.fit, e.held, *asked[k])
                        for k, e in enumerate(ensembles) if k in asked]
                replies = _pass(state, asks, features, bins)
                while former:  # the pass has filled its successor
                    former.pop().unpersist()
                for ask, reply in zip(asks, replies):
                    try:
                        asked[ask.place] = growing[ask.place].send(reply)
                    except StopIteration:
                        del asked[ask.place]
    finally:
        for df in (*former, state):
            df.unpersist()


class _Joint:
    """Rows with several inputs as one number, so that one count of its cells serves them all: their sums are those of its
    margins. Only combinations that occur have a cell, and an input joins the group whose cells it multiplies least (weeks
    tell the calendar, countries their region, a quiet product's lags are all 0), so few numbers hold all inputs. A row's
    numbers lie side by side in a power of two of bytes, so picking rows costs one short look-up a row."""

    def __init__(self, bins: list[np.ndarray], widths: list[int], order: np.ndarray | None = None):
        """``bins``: parts of a matrix, inputs x rows; ``widths``: bins of each input. With ``order`` rows come in that order, and
        the list is emptied when its parts have been read, so that memory holds them once."""
        self.widths, self.groups, numbers = widths, [], []
        self.levels = []  # of a group, an entry for each of its inputs: bin in each cell so far, first cell of each cell before
        for k in sorted(range(len(widths)), key=lambda k: (-widths[k], k)):
            x = np.concatenate([np.zeros(0, np.uint8), *[b[k] for b in bins]])
            x = x if order is None else x.take(order)
            some = slice(None, None, max(1, len(x) // BLOCK_ROWS))  # rows that tell which group is tried first
            growth = [len(np.unique(n[some].astype(np.int64) * widths[k] + x[some])) / max(1, len(np.unique(n[some]))) for n in numbers]
            for i in np.argsort(growth, kind="stable").tolist():
                fits = np.prod([widths[j] for j in self.groups[i]]) * widths[k] <= CELLS
                found = _joined(numbers[i], len(self.levels[i][-1][0]), x, widths[k], CELLS if fits else min(CELLS, len(x) // 4))
                if found:
                    break
            else:
                i = len(numbers)
                found = _joined(np.zeros(len(x), np.uint16), 1, x, widths[k], 256)
                numbers.append(None)
                self.groups.append([])
                self.levels.append([])
            numbers[i], level = found
            self.groups[i].append(k)
            self.levels[i].append(level)
        self.place, self.tables = {}, {}  # of an input: its group, and its bin in each cell of the group
        for i, (g, levels) in enumerate(zip(self.groups, self.levels)):
            above = np.arange(len(levels[-1][0]))
            for k, (digit, first) in zip(reversed(g), reversed(levels)):
                self.place[k], self.tables[k] = i, digit.take(above).astype(np.uint8)
                above = np.searchsorted(first, above, side="right") - 1
        if order is not None:
            bins.clear()
        self.columns = np.stack(numbers)
        del numbers
        self._lay_out()

    def _lay_out(self) -> None:
        """The numbers of each row side by side, for rows that are picked; whole columns serve all the others."""
        self.cells = np.zeros((self.columns.shape[1], 1 << (len(self.columns) - 1).bit_length()), np.uint16)
        self.cells[:, :len(self.columns)] = self.columns.T

    def rows(self, part) -> "_Joint":
        """The same over some of the rows (a view, if ``part`` is a slice)."""
        out = _Joint.__new__(_Joint)
        out.__dict__.update(self.__dict__)
        if isinstance(part, slice):
            out.cells, out.columns = self.cells[part], self.columns[:, part]
        else:
            out.columns = self.columns.take(part, axis=1)
            out._lay_out()
        return out

    def bins(self, rows: np.ndarray | None = None) -> np.ndarray:
        """Inputs x rows: all of them, or those given by number."""
        columns = self.columns if rows is None else self.cells.take(rows, axis=0).T
        return np.stack([self.tables[k].take(columns[self.place[k]]) for k in range(len(self.widths))])

    def parted(self, tree: Tree, k: int, rows: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Those of the rows (None: all) that go left at a node, and those that go right."""
        feature = int(tree.feature[k])
        cells, table = self.columns[self.place[feature]], self.tables[feature]
        if rows is not None:
            cells = cells.take(rows)
        left = tree.mask[k].take(table.take(cells)) if len(cells) < len(table) else tree.mask[k].take(table).take(cells)
        left, right = np.flatnonzero(left), np.flatnonzero(~left)
        return (left, right) if rows is None else (rows.take(left), rows.take(right))

    def counted(self, q: np.ndarray, bins: int, rows: np.ndarray | None = None) -> np.ndarray:
        """As :func:`_counted`, of one node: all rows, or those given by number."""
        n = len(q) if rows is None else len(rows)
        if n < MANY_JOINT:
            return _counted(self.bins(rows), q if rows is None else q.take(rows), None, 1, bins)[0]
        out = np.zeros((len(self.widths), bins, 2), np.int64)
        at = 0
        while at < n:
            size = 2 * MOST_JOINT
            while size > PIECE:  # as many rows as one number can count beside the sum of their residuals
                size //= 2
                part = slice(at, at + size)
                some = q[part] if rows is None else q.take(rows[part])
                total = float(np.abs(some).sum())
                unit = 2.0 ** np.ceil(np.log2(2 * total + 2))
                if len(some) * unit + total < 2.0 ** 53:
                    break
            sums = [np.zeros(len(levels[-1][0])) for levels in self.levels]
            for i in range(0, len(some), PIECE):
                weight = some[i:i + PIECE] + unit
                piece = slice(at + i, at + i + len(weight))
                columns = self.columns[:, piece] if rows is None else self.cells.take(rows[piece], axis=0).T
                for cells, found in zip(columns, sums):
                    found += np.bincount(cells, weight, len(found))
            both = np.zeros((len(self.widths), bins))
            for g, levels, found in zip(self.groups, self.levels, sums):
                for k, (digit, first) in zip(reversed(g), reversed(levels)):
                    both[k, :self.widths[k]] = np.bincount(digit, found, self.widths[k])
                    found = np.add.reduceat(found, first)
            count = np.rint(both / unit)
            out[..., 1] += count.astype(np.int64)
            out[..., 0] += (both - count * unit).astype(np.int64)
            at += len(some)
        return out


def _joined(number: np.ndarray, cells: int, x: np.ndarray, width: int, most: int):
    """Numbers of the combinations of ``number`` (below ``cells``) and ``x`` (below ``width``) that occur, in their order, and for
    each number ``x`` and, for each old one, the first new one. None if more than ``most`` occur."""
    both = number.astype(np.int32)
    both *= width
    both += x
    seen = np.zeros(cells * width, bool)
    seen[both] = True
    found = np.flatnonzero(seen)
    if len(found) > most:
        return None
    new = (np.cumsum(seen) - 1).astype(np.uint16)
    return new.take(both), (found % width, np.searchsorted(found // width, np.arange(cells if len(x) else 0)))


class _Rows:
    """The rows of a task, by week, counted for one ensemble. Rows of nodes are kept while a tree grows."""

    def __init__(self, ensemble: Ensemble, y: np.ndarray, joint: _Joint, weeks: np.ndarray, n_bins: int):
        self.n_bins, self.ensemble = n_bins, ensemble
        within = lambda d: slice(*np.searchsorted(weeks, [d[0], d[1] + 1]))
        fit, held = within(ensemble.fit), within(ensemble.held) if ensemble.held else slice(0, 0)
        self.y, self.joint = y[fit], joint.rows(fit)  # views: ensembles share the rows
        self.held_y, self.held_joint = y[held], joint.rows(held)
        self.f, self.held_f = np.full(len(self.y), ensemble.base), np.full(len(self.held_y), ensemble.base)
        self.q = np.zeros(len(self.y), np.int32)
        self.done, self.tree = 0, None

    def count(self, tree: Tree | None, nodes: list[int]) -> tuple[dict[int, np.ndarray], tuple[int, int]]:
        """Histograms by node; sum of the squared integer residuals held back, and their rows."""
        e = self.ensemble
        if tree is None:
            for t in e.trees[self.done:]:
                if self.tree is not None:
                    self._add_grown(t)
                else:
                    _add(t, self.joint, self.f)
                _add(t, self.held_joint, self.held_f)
                self.tree = None
            self.done = len(e.trees)
            for i in range(0, len(self.q), PIECE):
                part = slice(i, i + PIECE)
                self.q[part] = np.rint((self.y[part] - self.f[part]) * e.scale)
            self.at = {0: None}  # all rows
            self.tree = _ROOT
            return {0: self.joint.counted(self.q, self.n_bins)}, _loss(self.held_y - self.held_f, e.scale)
        for k in sorted(set(self.at)):
            if tree.feature[k] >= 0:  # split since the last count
                self.at[int(tree.left[k])], self.at[int(tree.right[k])] = self.joint.parted(tree, k, self.at.pop(k))
        self.tree = tree
        return {k: self.joint.counted(self.q, self.n_bins, self.at[k]) for k in nodes}, (0, 0)

    def _add_grown(self, final: Tree) -> None:
        """Add the tree that has just grown: its upper splits are those that rows have been dealt out by."""
        stack = [(0, 0)]  # nodes: of the tree as it was counted, of the final one
        while stack:
            k, end = stack.pop()
            if k not in self.at:
                leaf = final.feature[end] < 0  # splits below it were given up again
                stack += [(int(c), end if leaf else int(final_c[end])) for c, final_c in
                          ((self.tree.left[k], final.left), (self.tree.right[k], final.right))]
                continue
            rows = [(end, self.at[k])]
            while rows:  # splits that needed no count
                end, at = rows.pop()
                if final.feature[end] < 0:
                    self.f[slice(None) if at is None else at] += final.value[end]
                else:
                    rows += zip((int(final.left[end]), int(final.right[end])), self.joint.parted(final, end, at))


def _add(tree: Tree, joint: _Joint, f: np.ndarray) -> None:
    """Add a tree's values to the predictions of rows, a block at a time."""
    for at in range(0, len(f), BLOCK_ROWS):
        f[at:at + BLOCK_ROWS] += tree.value[tree.places(joint.rows(slice(at, at + BLOCK_ROWS)).bins())]


def _by_week(y: list[np.ndarray], bins: list[np.ndarray], weeks: list[np.ndarray], widths: list[int]):
    """Parts of a matrix as one, in the order of weeks, so that a range of days is a slice. The lists are emptied."""
    weeks_, y_ = np.concatenate([*weeks, np.zeros(0, np.int32)]), np.concatenate([*y, np.zeros(0)])
    weeks.clear(), y.clear()
    order = np.argsort(weeks_, kind="stable")
    y_, weeks_ = y_.take(order), weeks_.take(order)
    joint = _Joint(bins, widths, order)
    pa.default_memory_pool().release_unused()  # the parts were Arrow's
    return y_, joint, weeks_


def _grow_in_tasks(blocks: DataFrame, ensembles: list[Ensemble], features: int, bins: int, widths: list[int], nominal: np.ndarray) -> None:
    """Each ensemble in a task of its own, over all blocks of a matrix whose size has been checked."""

    def run(table: pa.Table) -> pa.Table:
        e = ensembles[table.column("e")[0].as_py()]
        order = np.argsort(table.column("block").to_numpy(), kind="stable")
        whole = table.take(pa.array(order)).combine_chunks().to_batches()[0]
        parts = [Block(whole, i, features) for i in range(whole.num_rows)]
        rows = _Rows(e, *_by_week([p.y for p in parts], [p.bins for p in parts], [p.weeks for p in parts], widths), bins)
        growing = e.growing(nominal)
        ask = next(growing)
        while True:
            found, loss = rows.count(*ask)
            try:
                ask = growing.send((found, _mean_loss(*loss, e.scale)))
            except StopIteration:
                break
        made = pickle.dumps((e.trees, e.losses))
        return pa.table({"e": table.column("e").slice(0, 1), "made": pa.array([made], pa.binary())})

    everyone = F.explode(F.array(*[F.lit(k) for k in range(len(ensembles))])).alias("e")
    dealt = blocks.select("products", "weeks", "y", "bins", "f", "ensembles", F.monotonically_increasing_id().alias("block"), everyone)
    dealt = dealt.drop("products").repartitionByRange(len(ensembles), "e")
    for r in dealt.groupBy("e").applyInArrow(run, "e int, made binary").collect():
        ensembles[r["e"]].trees, ensembles[r["e"]].losses = pickle.loads(r["made"])


def _slots(spark) -> int:
    """Tasks that run at once for sure, as a barrier stage needs them; 0 if executors come and go."""
    if spark.sparkContext.getConf().get("spark.dynamicAllocation.enabled", "false") == "true":
        return 0
    context = spark.sparkContext._jsc.sc()
    return context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile())


def _grow_together(blocks: DataFrame, ensembles: list[Ensemble], features: int, bins: int, widths: list[int], nominal: np.ndarray,
                   tasks: int, after: dict[int, int]) -> None:
    """In one job: tasks side by side hold a part of the blocks each, count what the ensembles ask for and exchange the counts.
    These are integers, so every task grows the same trees; the first one returns them. Ensembles take turns: while others
    still count for one, a task counts for the next."""

    def run(batches):
        exchange = _Exchange(folder)
        y, cells, weeks = [], [], []
        for batch in batches:
            for i in range(batch.num_rows):
                y.append(np.frombuffer(batch.column("y")[i].as_buffer(), np.float64))
                cells.append(np.frombuffer(batch.column("bins")[i].as_buffer(), np.uint8).reshape(features, -1))
                weeks.append(batch.column("weeks")[i].values.to_numpy())
            del batch
        held = _by_week(y, cells, weeks, widths)
        rows, growing, wanted = {}, {}, {}

        def begin(k):
            rows[k], growing[k] = _Rows(ensembles[k], *held, bins), ensembles[k].growing(nominal)
            count(k, next(growing[k]))

        def count(k, ask):
            counts = rows[k].count(*ask)
            wanted[k] = list(counts[0])
            exchange.post(k, _packed(*counts))

        def summed(k):
            sums, total = {node: np.zeros((features, bins, 2), np.int64) for node in wanted[k]}, [0, 0]
            for part in exchange.posted(k):
                found, loss = pickle.loads(part)
                for node, hist in found.items():
                    for i in (0, 1) if hist else ():
                        sums[node][..., i] += hist[i]
                total = [a + b for a, b in zip(total, loss)]
            return sums, _mean_loss(*total, ensembles[k].scale)

        for k in range(len(ensembles)):
            if k not in after:
                begin(k)
        while growing:
            for k in list(growing):
                try:
                    count(k, growing[k].send(summed(k)))
                except StopIteration:
                    del growing[k], rows[k]
                    for late, leader in after.items():
                        if leader == k:
                            ensembles[late].follow(ensembles[k])
                            begin(late)
        exchange.close()
        if exchange.me == 0:
            made = [pickle.dumps((e.trees, e.losses)) for e in ensembles]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(made)), pa.int32()), pa.array(made, pa.binary())], names=["e", "made"])

    folder = scratch(blocks.sparkSession, "counts")
    for r in _dealt(blocks, tasks).mapInArrow(run, "e int, made binary", barrier=True).collect():
        ensembles[r["e"]].trees, ensembles[r["e"]].losses = pickle.loads(r["made"])
    for late, leader in after.items():
        ensembles[late].follow(ensembles[leader])


def _dealt(blocks: DataFrame, tasks: int) -> DataFrame:
    """The blocks in as many partitions as there are tasks, of about equal numbers of rows, since all wait for the largest one."""
    numbered = blocks.select(F.monotonically_increasing_id().alias("block"), "weeks", "y", "bins")
    loads, places = [(0, t) for t in range(tasks)], []
    for r in sorted(numbered.select("block", F.size("weeks").alias("n")).collect(), key=lambda r: (-r["n"], r["block"])):  # a row a block
        rows, t = heapq.heappop(loads)
        heapq.heappush(loads, (rows + r["n"], t))
        places.append((r["block"], t))
    if not places:
        return blocks.select("weeks", "y", "bins").repartition(tasks)
    where = F.broadcast(blocks.sparkSession.createDataFrame(places, "block long, task int"))
    return numbered.join(where, "block", "left").repartitionById(tasks, F.coalesce("task", F.pmod("block", F.lit(tasks)).cast("int"))).select("weeks", "y", "bins")


class _Exchange:
    """Hands the bytes of each task to all tasks of a barrier stage, on channels of their own. A barrier's own ``allGather`` takes
    a second at least, so where all tasks see each other's files in the shared checkpoint folder, bytes go as files there."""

    def __init__(self, folder: str):
        self.context = BarrierTaskContext.get()
        self.me, self.tasks, self.steps, self.held = self.context.partitionId(), len(self.context.getTaskInfos()), {}, {}
        place = self.context.allGather(uuid.uuid4().hex)[0]  # one of its own for every attempt
        self.folder = f"{unquote(urlparse(folder).path)}/{place}"
        if urlparse(folder).scheme in ("", "file"):
            try:
                os.makedirs(self.folder, exist_ok=True)
                self._write("seen", b"")
            except OSError:
                pass  # seen below: its file is missing
        self.context.barrier()
        if any(self.context.allGather("" if all(os.path.exists(self._name("seen", k)) for k in range(self.tasks)) else "missing")):
            self.folder = None

    def _name(self, step: str, task: int) -> str:
        return f"{self.folder}/{step}-{task}"

    def _write(self, step: str, data: bytes) -> None:
        name = self._name(step, self.me)
        with open(f"{name}.part", "wb") as f:
            f.write(data)
        os.replace(f"{name}.part", name)

    def post(self, channel: int, data: bytes) -> None:
        """Hand over this task's next bytes on a channel."""
        if self.folder is None:
            self.held[channel] = base64.b64encode(zlib.compress(data, 1)).decode("ascii")
            return
        self.steps[channel] = self.steps.get(channel, 0) + 1
        self._write(f"{channel}-{self.steps[channel]}", data)

    def posted(self, channel: int) -> list[bytes]:
        """What all tasks have handed over by their last post on a channel. Tasks ask for channels in the same order."""
        if self.folder is None:
            return [zlib.decompress(base64.b64decode(t)) for t in self.context.allGather(self.held.pop(channel))]
        step, out = self.steps[channel], []
        for k in range(self.tasks):
            name = self._name(f"{channel}-{step}", k)
            while not os.path.exists(name):  # if a task fails, Spark ends the stage's other tasks
                time.sleep(0.0005)
            with open(name, "rb") as f:
                out.append(f.read())
        if step > 1:  # all tasks have come to this step, so they have read the one before
            os.remove(self._name(f"{channel}-{step - 1}", self.me))
        return out

    def close(self) -> None:
        """After the last exchange of all tasks: take away the files."""
        if self.folder is not None:
            self.context.barrier()
            for step in ("seen", *[f"{channel}-{step}" for channel, step in self.steps.items()]):
                os.remove(self._name(step, self.me))
            self.context.barrier()
            if self.me == 0:
                os.rmdir(self.folder)


def _packed(found: dict, loss: tuple[int, int]) -> bytes:
    """Counts of a task in few bytes: sums and rows in the smallest integers that hold them."""
    return pickle.dumps(({node: [_small(hist[..., i]) for i in (0, 1)] if hist[0, :, 1].any() else None for node, hist in found.items()}, loss))


def _small(x: np.ndarray) -> np.ndarray:
    top = int(np.abs(x).max(initial=0))
    return x.astype(np.int8 if top < 1 << 7 else np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)


class _PlainPlans:
    """Passes are many small jobs of one fixed form: adaptive planning would make two jobs of each."""

    def __init__(self, spark, tasks: int):
        # cells don't grow with the rows: a few reducers for many tasks
        self.spark, self.now = spark, {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(min(64, max(2, tasks // 4)))}

    def __enter__(self):
        self.before = {k: self.spark.conf.get(k) for k in self.now}
        for k, v in self.now.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_):
        for k, v in self.before.items():
            self.spark.conf.set(k, v)


def _start(blocks: DataFrame, ensembles: list[Ensemble]) -> int:
    """Mean of the rows to fit, and the scale of residuals, of new ensembles. Returns the number of all rows."""
    ranges = [*[e.fit for e in ensembles], (-(1 << 31), 1 << 31)]

    def run(batches):
        n, total = [0] * len(ranges), [0.0] * len(ranges)
        low, high = [np.inf] * len(ranges), [-np.inf] * len(ranges)
        for batch in batches:
            for i in range(batch.num_rows):
                y = np.frombuffer(batch.column("y")[i].as_buffer(), np.float64)
                weeks = batch.column("weeks")[i].values.to_numpy()
                for k, (first, last) in enumerate(ranges):
                    some = y[(weeks >= first) & (weeks <= last)]
                    if len(some):
                        n[k], total[k] = n[k] + len(some), total[k] + float(some.sum())
                        low[k], high[k] = min(low[k], some.min()), max(high[k], some.max())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(ranges)), pa.int32()), pa.array(n, pa.int64()), pa.array(total, pa.float64()),
                                          pa.array(low, pa.float64()), pa.array(high, pa.float64())], names=["e", "n", "total", "low", "high"])

    rows = blocks.select("y", "weeks").mapInArrow(run, "e int, n bigint, total double, low double, high double").groupBy("e").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    total = 0
    for r in rows:
        if r["e"] == len(ensembles):
            total = r["n"] or 0
            continue
        e = ensembles[r["e"]]
        if r["n"]:
            # a base of few bits, so that it doesn't depend on the order of the sum
            span = max(r["high"] - r["low"], abs(r["high"]), abs(r["low"]), 1e-9)
            e.scale = 2.0 ** (BITS - np.ceil(np.log2(2 * span)))
            e.base = float(np.rint(r["total"] / r["n"] * e.scale) / e.scale)
    return total


def _advanced(state: DataFrame, ensembles: list[Ensemble], since: list[int], features: int) -> DataFrame:
    """The blocks with the predictions of all ensembles so far."""
    news = [Ask(k, e.base, e.scale, e.trees[since[k]:], e.fit, None, None, []) for k, e in enumerate(ensembles)]

    def run(batches):
        for batch in batches:
            f = []
            for i in range(batch.num_rows):
                block = Block(batch, i, features)
                f.append(np.concatenate([a.predicted(block) for a in news]).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(f, pa.binary()), pa.array([len(news)] * batch.num_rows, pa.int32())], names=batch.schema.names)

    return state.mapInArrow(run, STATE)


# --- use of fitted ensembles --------------------------------------------------------------------
def predictions(blocks: DataFrame, ensemble: Ensemble, days: tuple[int, int], features: int) -> DataFrame:
    """``ProductID, WeekStart, y_true, y_pred`` of the rows of a range of days."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch, i, features)
                at = block.within(days)
                yield pa.RecordBatch.from_arrays([
                    batch.column("products")[i].values.take(pa.array(at)), pa.array(block.weeks[at]),
                    pa.array(block.y[at]), pa.array(ensemble.predict(block.bins[:, at]))], names=["ProductID", "week", "y_true", "y_pred"])

    rows = blocks.select("products", "weeks", "y", "bins", F.lit(b"").alias("f"), F.lit(0).alias("ensembles")).mapInArrow(
        run, "ProductID string, week int, y_true double, y_pred double")
    return rows.select("ProductID", F.date_add(F.lit(EPOCH), F.col("week")).alias("WeekStart"), "y_true", "y_pred")


def gain_importance(ensemble: Ensemble, names: list[str]) -> list[float]:
    """Share of each input in the gain of all splits."""
    total = np.zeros(len(names))
    for t in ensemble.trees:
        inner = t.feature >= 0
        np.add.at(total, t.feature[inner], t.gain[inner])
    return (total / total.sum() if total.sum() else total).tolist()
