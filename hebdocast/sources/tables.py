"""Scans and sinks (Parquet, CSV, JSON) with required-column checks."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class MissingColumnsError(ValueError):
    pass


def table_path(base: str, name: str) -> str:
    return os.path.join(base, f"{name}.parquet")


def read_table(spark: SparkSession, base: str, name: str,
               columns: Iterable[str] | None = None) -> DataFrame:
    """Column-pruned Parquet scan; the projection reaches the reader's ReadSchema."""
    df = spark.read.parquet(table_path(base, name))
    if columns is not None:
        cols = list(columns)
        require_columns(df, cols, what=name)
        df = df.select(*cols)
    return df


def require_columns(df: DataFrame, required: Iterable[str], what: str = "input") -> None:
    """Raise at plan time when required columns are absent, naming them."""
    missing = sorted(set(required).difference(df.columns))
    if missing:
        raise MissingColumnsError(f"{what} is missing required columns: {missing}")


def read_transactions(spark: SparkSession, path: str, fmt: str = "parquet",
                      schema: T.StructType | None = None) -> DataFrame:
    """Transaction scan (Parquet or CSV) followed by the required-column check."""
    from ..config import REQUIRED_COLUMNS

    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        df = reader.option("header", True).csv(path)
    elif fmt == "json":
        df = reader.json(path)
    else:
        df = reader.parquet(path)
    require_columns(df, REQUIRED_COLUMNS, what=f"transactions at {path}")
    return df


def read_checked(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """CSV or JSON rows as ``schema`` says, and the rows that can't be read so: ``(good, rejects)``.

    Every field is read as text and cast; a row is a reject if a field has text that its type doesn't take, or if the
    line itself is malformed (too few or many fields, broken JSON). Empty fields are nulls. ``rejects`` has
    ``record`` (the line, or the fields as JSON), ``reason`` (the offending columns) and ``file``."""
    names = [f.name for f in schema.fields]
    require_columns(spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.json(path), names,
                    what=f"transactions at {path}")
    text = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField("_line", T.StringType())])
    reader = spark.read.schema(text).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line")
    rows = reader.option("header", True).option("enforceSchema", False).csv(path) if fmt == "csv" else reader.json(path)
    filled = {n: F.when(F.trim(F.col(f"`{n}`")) != "", F.col(f"`{n}`")) for n in names}
    typed = {f.name: filled[f.name] if isinstance(f.dataType, T.StringType) else F.trim(filled[f.name]).try_cast(f.dataType)
             for f in schema.fields}
    bad = F.array_compact(F.array(F.when(F.col("_line").isNotNull(), F.lit("malformed record")),
                                  *[F.when(filled[n].isNotNull() & typed[n].isNull(), F.lit(n)) for n in names]))
    judged = rows.select("*", bad.alias("_bad"), F.input_file_name().alias("_file"))
    good = judged.where(F.size("_bad") == 0).select(*[typed[n].alias(n) for n in names])
    fields = F.to_json(F.struct(*[F.col(f"`{n}`") for n in names]))
    rejects = judged.where(F.size("_bad") > 0).select(F.coalesce("_line", fields).alias("record"),
                                                      F.array_join("_bad", ", ").alias("reason"), F.col("_file").alias("file"))
    return good, rejects


def write_parquet(df: DataFrame, path: str, partition_by: Iterable[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)
