"""Calendar sources: the weekly date spine and the holiday dimension."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def week_spine(spark: SparkSession, start: _dt.date, end: _dt.date | None = None,
               periods: int | None = None) -> DataFrame:
    """Inclusive Monday range (start..end), or ``periods`` weeks from start.

    Columns: ``week_index`` (1-based) and ``WeekStart``.
    """
    if end is None:
        if periods is None:
            raise ValueError("give end or periods")
        end = start + _dt.timedelta(days=7 * (periods - 1))
    seq = F.sequence(F.lit(start), F.lit(end), F.expr("INTERVAL 7 DAYS"))
    return (spark.range(1).select(F.posexplode(seq).alias("pos", "WeekStart"))
            .select((F.col("pos") + 1).cast("long").alias("week_index"), "WeekStart"))


def week_spine_of(weekly: DataFrame) -> DataFrame:
    """Spine over the observed weeks of a weekly table (min..max)."""
    bounds = weekly.agg(F.min("WeekStart").alias("lo"), F.max("WeekStart").alias("hi"))
    seq = F.sequence(F.col("lo"), F.col("hi"), F.expr("INTERVAL 7 DAYS"))
    return (bounds.select(F.posexplode(seq).alias("pos", "WeekStart"))
            .select((F.col("pos") + 1).cast("long").alias("week_index"), "WeekStart"))


def holiday_dim(spark: SparkSession, first_year: int, last_year: int,
                month_days: Sequence[tuple[int, int]]) -> DataFrame:
    """Holiday dates for every year in [first_year, last_year] from (month, day) rules."""
    md = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(d).alias("d")) for m, d in month_days])
    return (spark.range(1)
            .select(F.explode(F.sequence(F.lit(first_year), F.lit(last_year))).alias("year"))
            .select("year", F.explode(md).alias("md"))
            .select(F.make_date("year", "md.m", "md.d").alias("day"))
            .where(F.col("day").isNotNull()))


def holiday_dim_for(weekly: DataFrame, month_days: Sequence[tuple[int, int]]) -> DataFrame:
    """Holidays for the years the weekly table spans, plus the following year
    (a week starting late in December reaches into January)."""
    bounds = weekly.agg(F.year(F.min("WeekStart")).alias("y0"),
                        (F.year(F.max("WeekStart")) + 1).alias("y1"))
    md = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(d).alias("d")) for m, d in month_days])
    return (bounds.select(F.explode(F.sequence("y0", "y1")).alias("year"))
            .select("year", F.explode(md).alias("md"))
            .select(F.make_date("year", "md.m", "md.d").alias("day")))
