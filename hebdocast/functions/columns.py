"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_or(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def week_floor(ts: Column | str) -> Column:
    """Monday of the timestamp's week, as a DATE (midnight-normalised)."""
    return F.date_trunc("week", col_or(ts)).cast("date")


def weekday_mon0(ts: Column | str) -> Column:
    """Day of week with Monday = 0 ... Sunday = 6."""
    return F.weekday(col_or(ts))


def week_of_month(d: Column | str) -> Column:
    return (F.floor((F.dayofmonth(col_or(d)) - 1) / 7) + 1).cast("int")


def mode_lowest(c: Column | str) -> Column:
    """Most frequent non-null value; ties go to the lowest value; null if none."""
    return F.mode(col_or(c), deterministic=True)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null when b is 0 or null (never raises under ANSI)."""
    return F.try_divide(a, b)


def all_null(cols: list[str]) -> Column:
    """True when every column is null. Written as one coalesce so the optimizer
    does not expand it into a conjunction of per-column null constraints."""
    return F.coalesce(*[F.col(c).cast("string") for c in cols]).isNull()


def any_true(preds: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, [F.coalesce(p, F.lit(False)) for p in preds])


def _second_of_day(ts: Column) -> Column:
    """Seconds since midnight with their fraction (decimal)."""
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.date_part(F.lit("SECOND"), ts)


def days_between(later: Column | str, earlier: Column | str) -> Column:
    """Whole days from earlier to later, floored (negative leads floor down).

    Calendar-day difference plus a time-of-day correction, so the result does
    not depend on the session time zone (no DST shifts on wall-clock values).
    """
    a, b = col_or(later), col_or(earlier)
    days = F.datediff(F.to_date(a), F.to_date(b))
    return (days + F.floor((_second_of_day(a) - _second_of_day(b)) / 86400)).cast("long")


def ses_weight(alpha: float, position: Column, count: Column) -> Column:
    """Weight of the i-th of m values in simple exponential smoothing whose level
    starts at the first value: (1-a)^(m-1) for i = 1, a(1-a)^(m-i) otherwise."""
    decay = F.pow(F.lit(1.0 - alpha), (count - position).cast("double"))
    return F.when(position == 1, decay).otherwise(F.lit(alpha) * decay)


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg(F.pow(y - p, 2)))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def wmape(y: Column, p: Column) -> Column:
    """Pooled sum|err| / sum|y|, 0.0 when there is no demand (a ratio, not %)."""
    return F.coalesce(F.try_divide(F.sum(F.abs(y - p)), F.sum(F.abs(y))), F.lit(0.0))
