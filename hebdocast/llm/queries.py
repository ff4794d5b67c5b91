"""One registered query per operator: it applies the operator, with production parameters, to the
whole table and returns the digest columns of its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, licenses, near_dup, packing, pages, quality, secrets, source_audit, substring, token_counts,
               token_file, top_k, vector_codes)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_best_fit_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"),
                          max_tokens=4096, end_id=1)


@query
def op2_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"),
                                     limit=2048)


@query
def op3_bpe_round_trip(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@query
def op5_quality_rules(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"))


ORACLE["op5_quality_rules"] = quality.ORACLE


@query
def op8_minhash_near_dup(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), percent=75)


@query
def op4_substring_dedup(spark, sf_dir):
    return substring.substring_dedup(table(spark, sf_dir, "documents"), size=35)


@query
def op9_secret_scan(spark, sf_dir):
    return secrets.secret_findings(table(spark, sf_dir, "documents"))


@query
def op10_huffman_token_files(spark, sf_dir):
    return token_file.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2)


@query
def op6_tag_path_text(spark, sf_dir):
    return pages.main_texts(table(spark, sf_dir, "pages"))


@query
def op7_impact_ordered_top_k(spark, sf_dir):
    return top_k.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


ORACLE["op7_impact_ordered_top_k"] = top_k.ORACLE


@query
def op11_norm_of_sum_codes(spark, sf_dir):
    return vector_codes.digest(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)


ORACLE["op11_norm_of_sum_codes"] = vector_codes.oracle()


@query
def op13_source_divergence(spark, sf_dir):
    return source_audit.divergence(table(spark, sf_dir, "documents"), min_docs=30, smooth=5, top=50)


ORACLE["op13_source_divergence"] = source_audit.ORACLE


@query
def op12_license_scan(spark, sf_dir):
    return licenses.digest(table(spark, sf_dir, "documents"))
