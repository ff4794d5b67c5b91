"""The trees' inputs of whole panels, as arrays: the columns of ``features`` and ``regression.hv_frame`` over many
products at once.

A filled panel has some twelve rows for each weekly row, and a window operator hands every one of them through its
buffers again for each frame. Here tasks get the weekly rows, each product's in order in one partition, and lay out
a few hundred products side by side: weeks since a product's first one down, products across. A lag is then a shift,
and a frame a handful of additions in the order of the rows, so values are those of the windows to the last bit.
Filled rows never leave their task unless they are bins of a matrix or a product's last row.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..config import Params
from .features import CALENDAR, RUNNING, SAME_WEEK, lag_name
from .leakage import TARGET_MEAN

CELLS = 1 << 16  # of products side by side
EPOCH = _dt.date(1970, 1, 1)
WEEKLY = ("Sales_Qty", "Sales_USD", "dominant_dow", "pct_weekend_orders")  # read of a weekly row


def _lag(x: np.ndarray, k: int) -> np.ndarray:
    out = np.full(x.shape, np.nan)
    out[k:] = x[:len(x) - k] if k < len(x) else x[:0]
    return out


def _over(q: np.ndarray, w: int, stat: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray:
    """``stat`` of the ``w`` rows before each one, oldest first; fewer at the start of a series, nothing before its first row."""
    out = np.full(q.shape, np.nan)
    for t in range(1, min(w, len(q))):
        out[t] = stat([q[j] for j in range(t)])
    if len(q) > w:
        out[w:] = stat([q[j:len(q) - w + j] for j in range(w)])
    return out


def _mean(rows: list[np.ndarray]) -> np.ndarray:
    total = np.zeros(rows[0].shape)
    for x in rows:
        total += x
    return total / len(rows)


def _std(rows: list[np.ndarray]) -> np.ndarray:
    """As ``stddev_samp`` adds up row by row; unknown for a single row."""
    mean, m2 = np.zeros(rows[0].shape), np.zeros(rows[0].shape)
    if len(rows) < 2:
        return np.full(rows[0].shape, np.nan)
    for n, x in enumerate(rows, 1):
        delta = x - mean
        step = delta / n
        mean += step
        m2 += delta * (delta - step)
    return np.sqrt(m2 / (len(rows) - 1))


def inputs_of(weekly: dict[str, np.ndarray], names: Sequence[str], params: Params, ahead: bool = False) -> dict[str, np.ndarray]:
    """Inputs that follow from a product's own weeks, by name, over filled panels (weeks x products). ``ahead``: what the
    week after each row has seen, as the recursion starts from it (last week's values are the row's own, and the
    mean takes it in); lags and frames are those of the row itself."""
    q = weekly["Sales_Qty"]
    age = np.arange(len(q))[:, None]
    out: dict[str, np.ndarray] = {}

    def same_week(c: str) -> np.ndarray:
        if c == "unit_price":
            with np.errstate(divide="ignore", invalid="ignore"):
                return np.where(q > 0, weekly["Sales_USD"] / q, np.nan)
        if c == "zero_streak_length":
            last = np.maximum.accumulate(np.where(q != 0, age, -1), axis=0)
            return (age - last).astype(np.float64)
        if c == "cumulative_zero_weeks":
            return np.cumsum(q == 0, axis=0).astype(np.float64)
        return weekly[c]

    for c in names:
        if c == TARGET_MEAN:
            mean = np.cumsum(q, axis=0) / (age + 1)
            out[c] = mean if ahead else _lag(mean, 1)
        elif c in (*RUNNING, *SAME_WEEK):
            out[c] = same_week(c)
        elif c.endswith("_prev") and c[:-5] in (*RUNNING, *SAME_WEEK):
            out[c] = same_week(c[:-5]) if ahead else _lag(same_week(c[:-5]), 1)
    for k in params.lags:
        if lag_name(k) in names:
            out[lag_name(k)] = _lag(q, k)
    for w in params.windows:
        for name, stat in ((f"Sales_Qty_rollmean_{w}", _mean), (f"Sales_Qty_rollstd_{w}", _std)):
            if name in names:
                out[name] = _over(q, w, stat)
    return out


def calendar_of(day: int, holidays: set[_dt.date]) -> list[float]:
    """The values of ``CALENDAR`` of a week."""
    d = EPOCH + _dt.timedelta(days=day)
    return [d.month, (d.day - 1) // 7 + 1, (d.month + 2) // 3, d.isocalendar()[1], int(d.month in (11, 12)), int(d in holidays)]


def by_product(batches, columns: Sequence[str]) -> Iterator[tuple[pa.Array, np.ndarray, dict[str, np.ndarray]]]:
    """Products of about equal length, from rows in the order of product and week: ids, places of each product's first row
    (and the end), and ``columns`` of their rows (NaN: unknown)."""
    held: list[pa.RecordBatch] = []
    size = 0

    def parts(table: pa.Table):
        ids = table.column("ProductID").combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        n = len(ids)
        new = np.flatnonzero(pc.not_equal(ids.slice(1), ids.slice(0, n - 1)).to_numpy(zero_copy_only=False)) + 1
        first = np.concatenate([[0], new, [n]])
        values = {c: table.column(c).to_numpy().astype(np.float64) for c in columns}
        return ids, first, values

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < CELLS:
            continue
        ids, first, values = parts(pa.Table.from_batches(held))
        rest = int(first[-2])  # the last product may go on
        if rest:
            yield ids, first[:-1], values
            held = [b.slice(max(0, rest - at)) for b, at in zip(held, np.cumsum([0] + [b.num_rows for b in held])) if at + b.num_rows > rest]
            size = sum(b.num_rows for b in held)
    if held:
        yield parts(pa.Table.from_batches(held))


def panels(batches, names: Sequence[str], codes: Sequence[str], params: Params, last: _dt.date, holidays: Sequence[_dt.date],
           ahead: bool = False):
    """Filled panels up to the week ``last``: ids, number of weeks of each product, first weeks (days), and the arrays (weeks
    x products) of ``Sales_Qty``, of ``names`` and of ``codes`` (a row for each). Weeks past a product's number are void."""
    end, held, weeks = (last - EPOCH).days, set(holidays), {}
    for ids, first, rows in by_product(batches, ["day", *WEEKLY, *codes]):
        day = rows["day"].astype(np.int64)
        start, count = day[first[:-1]], np.diff(first)
        length = (end - start) // 7 + 1
        order = np.argsort(-length, kind="stable")
        at = 0
        while at < len(order):
            longest = int(length[order[at]])
            some = order[at:at + max(1, CELLS // longest)]
            at += len(some)
            n = count[some]
            column = np.repeat(np.arange(len(some)), n)
            row = np.arange(n.sum()) + np.repeat(first[some] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            place = (day[row] - start[some][column]) // 7
            grid = {}
            for c in WEEKLY:
                grid[c] = np.full((longest, len(some)), np.nan if c == "dominant_dow" else 0.0)
                grid[c][place, column] = rows[c][row]
            out = inputs_of(grid, names, params, ahead)
            if any(c in CALENDAR for c in names):
                days = start[some] + 7 * np.arange(longest)[:, None]
                low = int(days.min()) // 7
                every = range(int(days.min()), int(days.max()) + 1, 7)
                weeks |= {d: calendar_of(d, held) for d in every if d not in weeks}
                table = np.array([weeks[d] for d in every], np.float64)
                out |= {c: table[(days // 7 - low), k] for k, c in enumerate(CALENDAR) if c in names}
            yield (ids.take(pa.array(first[some])), length[some], start[some], grid["Sales_Qty"], out,
                   {c: rows[c][first[some]] for c in codes})


def rows_of_panels(batches, names: Sequence[str], codes: Sequence[str], params: Params, last: _dt.date, holidays: Sequence[_dt.date]):
    """Every row of the panels as record batches: ``id, week, y`` and the inputs as ``x0`` and so on, names before codes."""
    for ids, length, start, q, inputs, coded in panels(batches, names, codes, params, last, holidays):
        real = np.arange(len(q))[:, None] < length
        which = np.broadcast_to(np.arange(len(ids)), q.shape)[real]
        days = (start + 7 * np.arange(len(q))[:, None])[real]
        columns = [inputs[c][real] for c in names] + [coded[c][which] for c in codes]
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(which)), pa.array(days.astype(np.int32)), pa.array(q[real]), *[pa.array(x) for x in columns]],
            names=["id", "week", "y", *[f"x{i}" for i in range(len(columns))]])


def last_rows(batches, names: Sequence[str], codes: Sequence[str], params: Params, last: _dt.date, holidays: Sequence[_dt.date], window: int):
    """A row for each product that has begun by the week ``last``: ``ProductID, history`` (its last ``window`` quantities, oldest first,
    unknown before its first week) and the inputs that the coming week starts from."""
    for ids, length, start, q, inputs, coded in panels(batches, names, codes, params, last, holidays, ahead=True):
        column = np.arange(len(ids))
        back = length[:, None] - window + np.arange(window)
        history = np.where(back >= 0, q[np.maximum(back, 0), column[:, None]], np.nan)
        history = pa.array(history.ravel(), from_pandas=True)
        columns = [inputs[c][length - 1, column] for c in names] + [coded[c] for c in codes]
        yield pa.RecordBatch.from_arrays(
            [ids, pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * window, pa.int32()), history),
             *[pa.array(x, from_pandas=True) for x in columns]],
            names=["ProductID", "history", *[f"x{i}" for i in range(len(columns))]])
