"""Raw documents to packed training sequences.

Five stages, each on all that its predecessor kept: quality rules reject documents, one document of each
group of near-duplicates stays, repeated passages are cut out, secrets are replaced by a mark, and what is
left is packed into sequences. Each stage is written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hebdocast.llm import stages
from hebdocast.llm.common import written
from hebdocast.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.quality_stage(docs)


def minhash_near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.near_dup_stage(docs, percent=75)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.substring_stage(docs, size=35)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.secrets_stage(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.packing_stage(docs, tokenizer("word_bpe_49k.json"), max_tokens=4096, end_id=1)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", minhash_near_dup),
    ("substring dedup", substring_dedup),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]

# Links, components, a trained forest and a tokenizer's ids have no SQL; the tests hold the rows
# against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
