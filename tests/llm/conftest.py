from __future__ import annotations

import pytest

pytest.importorskip("public_tokenizers")

DOCS = "doc_id bigint, text string, source string, n_tokens int, kept string, sequence_id double"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, an empty and a very long text, ties, repeated rows and clashing columns."""
    prose = "The quick brown fox, aged 12½, doesn't jump.\nOver <|endoftext|> the  lazy dog\tété 日本語 "
    rows = [(1, prose, "a"), (2, None, "a"), (3, "", None), (None, "null id", "b"), (5, prose, "a"), (5, prose, "a"),
            (6, prose * 400, "c"), (7, " \n\t ", "c"), (8, "one", "c"), (8, "other text of one id", "c"),
            (9, "word " * 3000, "a"), (10, "x" * 5000, "a")]
    return spark.createDataFrame([(i, t, s, 1, "no", 0.5) for i, t, s in rows], DOCS)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def word_bpe():
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def byte_bpe():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
