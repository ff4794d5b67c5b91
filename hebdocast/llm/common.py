"""Shared folder, written intermediate tables and Arrow helpers of the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Tables that a Python worker keeps from task to task, and the operator that ran in it last.
_KEPT: list = []
_LAST = ""


def worker_for(operator: str) -> None:
    """Called inside tasks: a worker that turns to another operator frees what it kept."""
    global _LAST
    if operator != _LAST:
        for held in _KEPT:
            held.clear()
        _LAST = operator


# White space between words: space and the five ASCII controls 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``)."""
    return spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)


def new_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark).rstrip('/')}/hebdocast-llm/{app}/{label}-{uuid.uuid4().hex}"


def tasks_for(rows: int, each: int = 50_000) -> int:
    """Tasks for a step whose rows have been counted."""
    return max(4, -(-rows // each))


def written(df: DataFrame, label: str, tasks: int | None = None, **options) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a lineage cut that
    outlives any executor. ``tasks`` (see :func:`tasks_for`) joins partitions of small tables."""
    spark = df.sparkSession
    if tasks is not None:
        df = df.coalesce(tasks)
    path = new_path(spark, label)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._hebdocast_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._hebdocast_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def most_frequent(table: DataFrame, key: str, n: str, size: int) -> DataFrame:
    """The ``size`` rows of a :func:`written` table with the largest positive counts ``n``, ties to the smaller ``key``.
    A first pass counts rows by the length and the four leading bits of ``n`` (at most 500 groups), which tells how
    large ``n`` must be: all tasks together then hand on ``size`` rows and those of the
    last group, not ``size`` each. (Where the last group is large, such as words that occur once, a task still hands on at
    most ``size``.)"""
    bits = F.bin(F.col(n))
    groups = table.groupBy(F.length(bits).alias("length"), F.substring(bits, 1, 4).alias("lead")).count().collect()
    least, rows = 1, 0
    for length, lead, count in sorted(groups, reverse=True):
        least, rows = int(lead.ljust(length, "0"), 2), rows + count
        if rows >= size:
            break
    return table.filter(F.col(n) >= least).orderBy(F.desc(n), key).limit(size)


def pick(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id`` and ``text`` (UTF-8 bytes, null as empty) only, so that no other column of the
    input can clash with the operators' own names."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"),
                     F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("text"))


def hashes(id_col: str, text_col: str, *more: str) -> tuple[Column, Column]:
    """Two hashes that tell rows apart by text and by id, text and the columns ``more``; null text as empty."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    return F.xxhash64(text), F.xxhash64(F.lit(1), F.col(f"`{id_col}`"), text, *[F.col(f"`{c}`") for c in more])


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """As :func:`pick`, with ``k1, k2`` of :func:`hashes`."""
    k1, k2 = hashes(id_col, text_col)
    return df.select(F.col(f"`{id_col}`").alias("doc_id"),
                     F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("text"),
                     k1.alias("k1"), k2.alias("k2"))


def id_type(df: DataFrame, id_col: str) -> str:
    """Type of the id column; an untyped (all null) column counts as bigint."""
    kind = df.schema[id_col].dataType.simpleString()
    return "bigint" if kind == "void" else kind
