"""Stage 2 — cleaning of raw transactions.

Artifact rows are recognised by predicate (Spark has no row order), exact
duplicates are dropped over every raw column, ProductID is derived, dates are
parsed, and missing order dates are imputed from the median lead time. The
median is exact and computed by the cluster (see ``functions.quantiles``); it
reaches the row plan as a literal, so no join with a one-row table is needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ARTIFACT_FOOTER_PREFIX, ARTIFACT_TOTAL_REGION, REQUIRED_COLUMNS
from ..functions.columns import all_null, any_true, days_between

PRODUCT_ID_LENGTH = 9
DATE_COLUMNS = ("Order Date", "Invoice Date")


def artifact_predicate() -> "F.Column":
    """True for the Total row, the all-null spacer and the filter footer."""
    region = F.col("Region")
    return any_true([
        region == ARTIFACT_TOTAL_REGION,
        region.startswith(ARTIFACT_FOOTER_PREFIX),
        all_null(list(REQUIRED_COLUMNS)),
    ])


def artifact_rows(raw: DataFrame) -> DataFrame:
    """The artifact rows with an explanation (profiling view)."""
    region = F.col("Region")
    reason = (F.when(region == ARTIFACT_TOTAL_REGION, F.lit("pivot total row"))
              .when(region.startswith(ARTIFACT_FOOTER_PREFIX), F.lit("filter footer row"))
              .otherwise(F.lit("blank spacer row")))
    return raw.where(artifact_predicate()).withColumn("artifact_reason", reason)


def drop_artifacts(raw: DataFrame) -> DataFrame:
    return raw.where(~artifact_predicate())


def artifact_violations(raw: DataFrame, expected: int = 3) -> DataFrame:
    """One row when the artifact count differs from the export's three rows."""
    return (raw.agg(F.count_if(artifact_predicate()).alias("artifact_rows"))
            .where(F.col("artifact_rows") != expected))


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """Exact duplicates over every raw column (nulls compare equal)."""
    return df.dropDuplicates()


def with_product_id(df: DataFrame) -> DataFrame:
    return df.withColumn("ProductID", F.substring(F.col("Product Code").cast("string"), 1,
                                                  PRODUCT_ID_LENGTH))


def product_id_violations(df: DataFrame) -> DataFrame:
    pid = F.col("ProductID")
    return df.where(pid.isNull() | (F.length(pid) != PRODUCT_ID_LENGTH))


def parse_dates(df: DataFrame, columns=DATE_COLUMNS) -> DataFrame:
    """Strings become timestamps with unparsable values as null; timestamps stay."""
    out = df
    for c in columns:
        dtype = df.schema[c].dataType
        if isinstance(dtype, T.StringType):
            out = out.withColumn(c, F.try_to_timestamp(F.col(c)).cast("timestamp_ntz"))
        elif isinstance(dtype, T.DateType):
            out = out.withColumn(c, F.col(c).cast("timestamp_ntz"))
        elif isinstance(dtype, T.TimestampType):
            out = out.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return out


def lead_days(df: DataFrame) -> DataFrame:
    """Whole days from order to invoice over rows with both dates."""
    both = F.col("Order Date").isNotNull() & F.col("Invoice Date").isNotNull()
    return df.where(both).select(days_between("Invoice Date", "Order Date").alias("lead_days"))


def lead_stats(df: DataFrame) -> DataFrame:
    """One row: median lead days (exact, truncated toward 0) and negative share."""
    days = lead_days(df).groupBy("lead_days").agg(F.count(F.lit(1)).alias("n"))  # a few thousand days
    return days.agg(
        F.percentile("lead_days", 0.5, F.col("n")).cast("int").alias("median_lead_days"),
        F.try_divide(F.sum(F.when(F.col("lead_days") < 0, F.col("n")).otherwise(0)).cast("double"),
                     F.sum("n")).alias("negative_lead_rate"))


def _one_row_pair(a: DataFrame, b: DataFrame) -> DataFrame:
    """Combine two single-row frames by a constant key (no cartesian product)."""
    key = F.lit(1).alias("_k")
    return a.select(key, "*").join(b.select(key, "*"), "_k").drop("_k")


@dataclass
class CleanResult:
    cleaned: DataFrame
    median_lead_days: int
    negative_lead_rate: float


def impute_order_date(df: DataFrame, median_lead: int) -> DataFrame:
    """Missing Order Date := Invoice Date - median lead days."""
    imputed = F.col("Invoice Date") - F.make_dt_interval(days=F.lit(int(median_lead)))
    return df.withColumn("Order Date",
                         F.coalesce(F.col("Order Date"), imputed).cast("timestamp_ntz"))


def impute_violations(df: DataFrame) -> DataFrame:
    """Rows that cannot be imputed (both dates missing)."""
    return df.where(F.col("Order Date").isNull() & F.col("Invoice Date").isNull())


def prepared(raw: DataFrame) -> DataFrame:
    """Artifacts dropped, deduplicated, ProductID derived, dates parsed."""
    return parse_dates(with_product_id(drop_exact_duplicates(drop_artifacts(raw))))


def clean_transactions(raw: DataFrame, median_lead: int | None = None) -> CleanResult:
    """Full cleaning job. ``median_lead`` may be given to skip the statistics job."""
    base = prepared(raw)
    if median_lead is None:
        row = lead_stats(base).first()
        median_lead, neg_rate = int(row["median_lead_days"]), float(row["negative_lead_rate"])
    else:
        neg_rate = float("nan")
    return CleanResult(impute_order_date(base, median_lead), median_lead, neg_rate)


def clean_audit(raw: DataFrame, median_lead: int, negative_rate: float) -> DataFrame:
    """One row of cleaning counts; all counts come from one pass over raw plus
    one distinct count."""
    post = drop_artifacts(raw)
    counts = raw.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(artifact_predicate()).alias("artifact_rows_dropped"),
        F.count_if(~artifact_predicate() & F.col("Order Date").isNull()).alias("_null_order"),
    )
    dedup = drop_exact_duplicates(post)
    d = dedup.agg(F.count(F.lit(1)).alias("cleaned_rows"),
                  F.count_if(F.col("Order Date").isNull()).alias("missing_order_dates_imputed"))
    out = _one_row_pair(counts, d)
    return out.select(
        "raw_rows", "artifact_rows_dropped",
        (F.col("raw_rows") - F.col("artifact_rows_dropped") - F.col("cleaned_rows"))
        .alias("duplicate_rows_dropped"),
        "missing_order_dates_imputed",
        F.lit(int(median_lead)).alias("median_lead_days"),
        F.lit(float(negative_rate)).alias("negative_lead_rate"),
        "cleaned_rows",
    )
