"""Token counts of whole texts without their ids.

Pre-tokens are counted once: every task lists its distinct pre-tokens with their frequencies, one
aggregate merges the lists, and the tokenizer's model says for each distinct pre-token how many
pieces it has. That dictionary is then joined to the pre-token frequencies of each document and the
products are summed; no ids are made.

Scale: the dictionary grows with the input, so it is joined by a shuffle. Only its ``HOT`` most
frequent entries, each at most 64 characters long, are handed to the tasks (under 10 MB whatever the
input); they settle nine tenths of all pre-tokens inside the scan, so the shuffle carries only the
rare ones, and no key of the shuffled join is frequent.

Defined results: a null text is empty and counts 0 tokens; a null id is kept; every row gives one
row, repeated ones too; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _KEPT, id_type, most_frequent, pick, written
from .tokens import Tokens, tokens

HOT = 65_536
SPECIAL = "\x00"  # before a pre-token that only the library may split


class _Split(dict):
    """Block of a text -> its pre-tokens."""

    def __init__(self, table: Tokens):
        super().__init__()
        self.table = table

    def __missing__(self, block: bytes) -> tuple[str, ...]:
        text = block.decode("utf-8", "replace")
        pieces = self.table.pretokens(text)
        out = (SPECIAL + text,) if pieces is None else tuple(pieces)
        if len(block) <= 64:
            if len(self) >= 400_000:
                self.clear()
            self[block] = out
        return out


_SPLIT: dict[str, _Split] = {}
_KEPT.append(_SPLIT)


def _split(path: str) -> _Split:
    """The worker's table of pre-tokens for a tokenizer file."""
    if path not in _SPLIT:
        _SPLIT[path] = _Split(tokens(path))
    return _SPLIT[path]


def _blocks(table: Tokens, text: bytes) -> list[bytes]:
    """Blocks of a text. One that must stay whole is a single block of its own."""
    blocks = table.blocks(text)
    return [text] if blocks is None else blocks


def _pieces(split: _Split, table: Tokens, block: bytes) -> tuple[str, ...]:
    if table.kind == "byte" and len(block) > 1 and table.blocks(block) is None:
        return (SPECIAL + block.decode("utf-8", "replace"),)
    return split[block]


def _add(split: _Split, table: Tokens, blocks: Counter, into: Counter) -> None:
    for block, n in blocks.items():
        for piece in _pieces(split, table, block):
            into[piece] += n


def pretoken_dictionary(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Distinct pre-tokens of ``docs`` (columns as :func:`common.pick`): ``piece, freq, n``."""

    def gather(batches):
        table, split = tokens(tokenizer), _split(tokenizer)
        found: Counter = Counter()
        for batch in batches:
            blocks: Counter = Counter()
            for text in batch.column("text"):
                blocks.update(_blocks(table, text.as_py()))
                if len(blocks) > 200_000:
                    _add(split, table, blocks, found)
                    blocks = Counter()
            _add(split, table, blocks, found)
            if len(found) > 400_000:
                yield _rows(found)
                found = Counter()
        if found:
            yield _rows(found)

    def _rows(found):
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()),
                                           pa.array(list(found.values()), pa.int64())], ["piece", "freq"])

    def count(batches):
        table = tokens(tokenizer)
        model = table.tok.model
        for batch in batches:
            n = [len(table.whole(p[1:].encode())) // 4 if p.startswith(SPECIAL) else len(model.tokenize(p))
                 for p in batch.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("piece"), batch.column("freq"),
                                              pa.array(n, pa.int64())], ["piece", "freq", "n"])

    merged = (docs.select("text").mapInArrow(gather, "piece string, freq bigint")
              .groupBy("piece").agg(F.sum("freq").alias("freq")))
    return merged.mapInArrow(count, "piece string, freq bigint, n bigint")


def token_counts(docs: DataFrame, tokenizer: str, *, limit: int = 2048, hot: int = HOT,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row."""
    spark = docs.sparkSession
    rows = pick(docs, id_col, text_col)
    dictionary = written(pretoken_dictionary(rows, tokenizer), "pretokens")
    common = (most_frequent(dictionary.filter(F.length("piece") <= 64), "piece", "freq", hot)
              .select("piece", "n").collect())  # at most hot rows of at most 64 characters
    known = spark.sparkContext.broadcast({r["piece"]: r["n"] for r in common})

    class Known(dict):
        """Block -> (tokens of its common pre-tokens, its rare pre-tokens)."""

        def __init__(self, table, split):
            super().__init__()
            self.table, self.split, self.n = table, split, known.value

        def __missing__(self, block):
            here, rare = 0, []
            for piece in _pieces(self.split, self.table, block):
                n = self.n.get(piece)
                if n is None:
                    rare.append(piece)
                else:
                    here += n
            if rare:
                self.rare[block] = rare
            self[block] = here
            return here

    def frequencies(batches):
        table, split = tokens(tokenizer), _split(tokenizer)
        here = Known(table, split)
        here.rare = {}
        for batch in batches:
            take, piece, times = [], [], []
            if len(here) > 400_000:
                here.clear()
                here.rare.clear()
            for row, text in enumerate(batch.column("text")):
                blocks = _blocks(table, text.as_py())
                take.append(row)
                piece.append(None)
                times.append(sum(map(here.__getitem__, blocks)))
                left: Counter = Counter()
                for block in filter(here.rare.__contains__, blocks):
                    left.update(here.rare[block])
                take += [row] * len(left)
                piece += left
                times += left.values()
            at = pa.array(take, pa.int32())
            sizes = pa.array([len(x.as_py()) for x in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(at), batch.column("doc_id").take(at), sizes.take(at),
                 pa.array(piece, pa.string()), pa.array(times, pa.int64())],
                ["row", "doc_id", "n_bytes", "piece", "times"])

    # A row's number is good within this one job: no later job joins on it.
    long = (rows.withColumn("row", F.monotonically_increasing_id())
            .mapInArrow(frequencies, f"row bigint, doc_id {id_type(docs, id_col)}, n_bytes bigint, "
                                     "piece string, times bigint"))
    # The row of a document's common pre-tokens has no piece; a key of its own spreads those rows.
    long = long.withColumn("key", F.coalesce("piece", F.concat(F.lit("\x00\x00"), F.col("row").cast("string"))))
    counted = long.join(dictionary.select(F.col("piece").alias("key"), "n"), "key", "left")
    total = F.sum(F.col("times") * F.when(F.col("piece").isNull(), 1).otherwise(F.col("n")))
    return (counted.groupBy("row", "doc_id", "n_bytes").agg(total.cast("bigint").alias("n_tokens"))
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
