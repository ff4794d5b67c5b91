"""Stage 3 — product scoping by category lists (null ranges are kept)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalise(c: Column | str) -> Column:
    """trim + upper; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.upper(F.trim(c))


def excluded_flag(ranges: Sequence[str], col: str = "Product Range") -> Column:
    """True when the normalised range is in the list; null-safe (null -> False).

    A literal IN-set stays inside generated code; no join is needed for a
    fixed list.
    """
    return F.coalesce(normalise(col).isin(list(ranges)), F.lit(False))


def scope_products(cleaned: DataFrame, ranges: Sequence[str]) -> DataFrame:
    return cleaned.where(~excluded_flag(ranges))


def split_products(cleaned: DataFrame, ranges: Sequence[str],
                   named: Sequence[str] | None = None) -> DataFrame:
    """Products with both kept and excluded rows (one aggregate, no joins)."""
    flag = excluded_flag(ranges)
    src = cleaned if not named else cleaned.where(F.col("ProductID").isin(list(named)))
    return (src.groupBy("ProductID")
            .agg(F.count_if(~flag).alias("kept_rows"), F.count_if(flag).alias("excluded_rows"))
            .where((F.col("kept_rows") > 0) & (F.col("excluded_rows") > 0)))


def named_split_violations(cleaned: DataFrame, ranges: Sequence[str],
                           named: Sequence[str]) -> DataFrame:
    """Named split products that lack kept or excluded rows."""
    spark = cleaned.sparkSession
    found = split_products(cleaned, ranges, named).select("ProductID")
    wanted = spark.createDataFrame([(p,) for p in named], "ProductID string")
    return wanted.join(found, "ProductID", "left_anti")


def scope_violations(scoped: DataFrame, ranges: Sequence[str]) -> DataFrame:
    """Rows left in scope whose range is excluded (must be empty)."""
    return scoped.where(excluded_flag(ranges))


def scope_audit(cleaned: DataFrame, ranges: Sequence[str]) -> DataFrame:
    """Rows and distinct products before and after, in one aggregate pass."""
    flag = excluded_flag(ranges)
    return cleaned.agg(
        F.count(F.lit(1)).alias("cleaned_rows"),
        F.count_if(flag).alias("excluded_rows"),
        F.count_if(~flag).alias("scoped_rows"),
        F.countDistinct("ProductID").alias("cleaned_products"),
        F.countDistinct(F.when(~flag, F.col("ProductID"))).alias("scoped_products"),
    )


def exclusion_counts(cleaned: DataFrame, merchandise: Sequence[str],
                     rubber: Sequence[str]) -> DataFrame:
    """Rows per exclusion family and in total."""
    return cleaned.agg(
        F.count_if(excluded_flag(merchandise)).alias("merchandise_rows"),
        F.count_if(excluded_flag(rubber)).alias("rubber_rows"),
        F.count_if(excluded_flag(list(merchandise) + list(rubber))).alias("excluded_rows"),
    )
