"""The operators as pipeline stages: documents in, documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_dup, packing, quality, secrets, substring


def quality_stage(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The documents that pass the quality rules, without the lines above the limits; ``n_chars``, if
    there, is counted anew."""
    return _counted(quality.cleaned(docs, text_col=text_col, **options), text_col)


def near_dup_stage(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of near-duplicates, repeated rows and null ids too."""
    return near_dup.without_duplicates(docs, **options)


def substring_stage(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The documents without repeated passages; ``n_chars``, if there, is counted anew."""
    return _counted(substring.without_repeats(docs, text_col=text_col, **options), text_col)


def secrets_stage(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The documents with secrets replaced by a mark; ``n_chars``, if there, is counted anew."""
    return _counted(secrets.redacted(docs, text_col=text_col, **options), text_col)


def packing_stage(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Placed pieces of the documents, see :func:`packing.packed`."""
    return packing.packed(docs, tokenizer, **options)


def _counted(docs: DataFrame, text_col: str) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length(f"`{text_col}`").cast(kind))
