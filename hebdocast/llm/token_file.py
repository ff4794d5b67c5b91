"""Token ids in files under a canonical, length-limited Huffman code.

The texts are encoded once, in ascending id order, into blocks of whole documents. The counts of all
ids (one per entry of the vocabulary) give code lengths of at most ``max_bits``, and canonical codes
follow from the lengths alone. Each block is then coded for itself: it holds its documents' ids and
lengths, the bits of their codes, and the bit offset of every ``STEP``-th token. Decoding looks up
``max_bits`` bits at a time in one table, for all checkpoints of many blocks at once.

File format (a folder of Parquet files, so any store that Spark writes to will do): one row a block
with ``file`` (place of the file in the order of ids), ``block`` (place in the file), ``docs`` (array
of id and token count, in order), ``bits`` (codes, most significant bit first, padded to a byte),
``checkpoints`` (bit offset of every ``STEP``-th token). A second folder, ``code``, has the lengths:
``id, bits``.

Scale: the texts are shuffled once, by ranges of the document id; the uncoded blocks are a table in
the shared folder that goes when the files are written. The tasks that encode also count; summing shuffles one
row per used id and task. Nothing but the code table (bounded by the vocabulary) reaches the driver. The
tokens before each file come from a running sum over one row a file.

Defined results: a null text is empty and has only the end token; null ids come first; rows that
repeat an id follow each other in the order of a hash of their texts; an empty table gives no rows and no blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, id_type, new_path, pick, written
from .tokens import crc, tokens

MAX_BITS = 17
STEP = 256  # tokens from one checkpoint to the next
BLOCK_TOKENS = 1 << 16


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Lengths of an optimal prefix code with at most ``max_bits`` bits; 0 for unused ids. Package
    merge: in each round neighbours pair up and join the single symbols; a symbol is as long as the
    number of cheapest packages that hold it."""
    used = np.flatnonzero(counts > 0)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << max_bits:
        raise ValueError("max_bits is too small for this vocabulary")
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    # One level's list: the weights in order and whether each entry is a single symbol.
    levels, packages = [], np.empty(0)
    for _ in range(max_bits):
        both = np.concatenate([weight, packages])
        single = np.concatenate([np.ones(len(weight), bool), np.zeros(len(packages), bool)])
        rank = np.argsort(both, kind="stable")
        both, single = both[rank], single[rank]
        levels.append(single)
        packages = both[0:len(both) // 2 * 2:2] + both[1:len(both) // 2 * 2:2]
    take = 2 * (len(order) - 1)
    depth = np.zeros(len(order), np.int64)
    for single in reversed(levels):  # from the last list back: singles gain a bit, packages open
        singles = int(single[:take].sum())
        depth[:singles] += 1
        take = 2 * (take - singles)
    lengths[order] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code of every symbol: by length, then by symbol, counting up."""
    codes = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    bits = lengths[order].astype(np.int64)
    top = int(bits.max(initial=0))
    starts = np.cumsum(np.concatenate([[0], (1 << (top - bits))]))[:-1]
    codes[order] = starts >> (top - bits)
    return codes


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Codes of ``ids`` (at most 17 bits) one after the other, and the bit offsets of every
    ``STEP``-th id."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    if not len(ids):
        return b"", starts
    value = codes[ids].astype(np.uint64) << (64 - size - (starts & 31)).astype(np.uint64)
    # A code starts in every 32-bit word; the codes that start in one fill disjoint bits of the 64 from it on.
    first = np.flatnonzero(np.diff(starts >> 5, prepend=-1))
    sums = np.add.reduceat(value, first)
    out = np.zeros(len(sums) + 1, ">u4")
    out[:-1] = sums >> np.uint64(32)
    out[1:] |= (sums & np.uint64(0xFFFFFFFF)).astype(">u4")
    return out.tobytes()[:-(-int(ends[-1]) // 8)], starts[::STEP]


class Decoder:
    """Table of ``top`` bits to symbol and length."""

    def __init__(self, lengths: np.ndarray):
        codes = canonical(lengths)
        self.top = int(lengths.max(initial=1))
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        span = 1 << (self.top - lengths[order].astype(np.int64))
        assert (codes[order] << (self.top - lengths[order].astype(np.int64)) == np.cumsum(span) - span).all()
        self.symbol = np.zeros(1 << self.top, np.uint32)
        self.length = np.ones(1 << self.top, np.uint8)
        self.symbol[:span.sum()] = np.repeat(order, span)
        self.length[:span.sum()] = np.repeat(lengths[order], span)

    def decode(self, bits: list[bytes], checkpoints: list[np.ndarray], sizes: list[int]) -> list[np.ndarray]:
        """Ids of every block; all checkpoints advance together, one token a turn."""
        base = np.cumsum([0] + [len(b) for b in bits])
        raw = np.frombuffer(b"".join(bits) + bytes(8), np.uint8).astype(np.uint32)
        # the 32 bits from every byte on
        words = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        at = np.concatenate([c + 8 * b for c, b in zip(checkpoints, base)]).astype(np.int64)
        first = np.cumsum([0] + sizes)
        start = np.concatenate([np.arange(0, n, STEP) + f for n, f in zip(sizes, first)]).astype(np.int64)
        left = np.concatenate([np.minimum(STEP, n - np.arange(0, n, STEP)) for n in sizes]).astype(np.int64)
        out = np.zeros(first[-1], np.uint32)
        order = np.argsort(-left, kind="stable")
        at, start, left = at[order], start[order], left[order]
        live = len(left)
        for k in range(int(left.max(initial=0))):
            while live and left[live - 1] <= k:
                live = int(np.searchsorted(-left, -k, side="left"))
            now = at[:live]
            code = (words[now >> 3] >> (32 - self.top - (now & 7)).astype(np.uint32)) & ((1 << self.top) - 1)
            out[start[:live] + k] = self.symbol[code]
            at[:live] = now + self.length[code]
        return np.split(out, first[1:-1])


def id_width(tokenizer: str, end_id: int) -> str:
    """Numbers that hold every id of a tokenizer: 16 or 32 bits, little-endian."""
    from tokenizers import Tokenizer
    return "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id) <= 1 << 16 else "<u4"


def plain_blocks(docs: DataFrame, tokenizer: str, end_id: int, width: str, id_col: str, text_col: str) -> DataFrame:
    """Blocks of whole documents in ascending id order: ``file, block, docs, ids`` (of ``width``), and on the last block
    of each file ``counts``: the file's used ids, each with its number."""
    kind, end = id_type(docs, id_col), np.array([end_id], "<u4").tobytes()

    def blocks(batches):
        words = tokens(tokenizer)
        file, block = TaskContext.get().partitionId(), 0
        keys, sizes, parts, size = [], [], [], 0
        total = np.zeros(1, np.int64)

        def row(last):
            nonlocal total
            found = np.frombuffer(b"".join(parts), "<u4")
            sums = np.bincount(found, minlength=len(total))
            sums[:len(total)] += total
            total = sums
            entries = pa.StructArray.from_arrays([pa.array(keys, key_type), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])
            used = np.flatnonzero(total) if last else np.zeros(0, np.int64)
            counts = pa.StructArray.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])
            return pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int32()), pa.array([block], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), entries),
                 pa.array([found.astype(width).tobytes()], pa.binary()),
                 pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()), counts)],
                ["file", "block", "docs", "ids", "counts"])

        for batch in batches:
            key_type = batch.column("doc_id").type
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                if size >= BLOCK_TOKENS:
                    yield row(False)
                    block += 1
                    keys, sizes, parts, size = [], [], [], 0
                words.trim()
                ids = words.ids(text.as_py()) + end
                keys.append(key)
                sizes.append(len(ids) // 4)
                parts.append(ids)
                size += len(ids) // 4
        if keys:
            yield row(True)

    # The hash lets the rows of one much repeated id spread over several ranges.
    keyed = pick(docs, id_col, text_col).withColumn("hash", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash")
    return ordered.mapInArrow(blocks, f"file int, block bigint, docs array<struct<doc_id:{kind},n_tokens:bigint>>, ids binary, "
                                      "counts array<struct<id:bigint,n:bigint>>")


def id_counts(blocks: DataFrame) -> DataFrame:
    """``id, n`` over all blocks, from the counts that stand on the last block of each file."""
    return blocks.select(F.inline("counts")).groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 2, max_bits: int = MAX_BITS,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every text, each with ``end_id`` behind it, to the folder ``path``."""
    spark = docs.sparkSession
    if max_bits > MAX_BITS:
        raise ValueError(f"codes may have {MAX_BITS} bits at most")
    width = id_width(tokenizer, end_id)
    blocks = written(plain_blocks(docs, tokenizer, end_id, width, id_col, text_col), "blocks", compression="zstd")
    table = id_counts(blocks).collect()  # one row per used id: bounded by the vocabulary
    counts = np.zeros(max([end_id, *(r["id"] for r in table)]) + 1, np.int64)
    for r in table:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts, max_bits)
    codes = canonical(lengths)
    code = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(code, "id bigint, bits int").coalesce(1).write.parquet(f"{path}/code")

    def coded(batches):
        for batch in batches:
            bits, marks = [], []
            for ids in batch.column("ids"):
                b, m = pack_bits(np.frombuffer(ids.as_buffer(), width), codes, lengths)
                bits.append(b)
                marks.append(m)
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), batch.column("docs"), pa.array(bits, pa.binary()),
                 pa.array(marks, pa.list_(pa.int64()))], ["file", "block", "docs", "bits", "checkpoints"])

    kind = id_type(docs, id_col)
    schema = (f"file int, block bigint, docs array<struct<doc_id:{kind},n_tokens:bigint>>, bits binary, "
              "checkpoints array<bigint>")
    blocks.drop("counts").mapInArrow(coded, schema).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    discard(blocks)


def read_tokens(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """Every document of the files: ``doc_id, start`` (tokens before it), ``n_tokens, ids_crc32`` and
    on request ``ids`` (binary, little-endian unsigned 32-bit)."""
    stored = spark.read.parquet(f"{path}/blocks")
    code = spark.read.parquet(f"{path}/code").collect()  # bounded by the vocabulary
    lengths = np.zeros(max((r["id"] for r in code), default=0) + 1, np.uint8)
    for r in code:
        lengths[r["id"]] = r["bits"]

    # Tokens before each block: blocks are summed per file, files in order.
    tokens_of = F.aggregate("docs", F.lit(0).cast("bigint"), lambda a, d: a + d["n_tokens"])
    sizes = stored.select("file", "block", tokens_of.alias("n"))
    files = sizes.groupBy("file").agg(F.sum("n").alias("n"))
    before = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("file_start"))
    inside = Window.partitionBy("file").orderBy("block")
    starts = sizes.withColumn("start", F.sum("n").over(inside) - F.col("n")).join(before, "file").select(
        "file", "block", (F.col("start") + F.col("file_start")).alias("start"))

    def unpack(batches):
        decoder = Decoder(lengths)
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # some 100 blocks hold enough checkpoints to advance together
                part = batch.slice(at, 100)
                at += part.num_rows
                docs = part.column("docs")
                counts = [np.asarray(d.values.field("n_tokens")) for d in docs]
                found = decoder.decode(part.column("bits").to_pylist(),
                                       [np.asarray(c.values) for c in part.column("checkpoints")],
                                       [int(c.sum()) for c in counts])
                file, block, keys, rel, sizes, crcs, raw = [], [], [], [], [], [], []
                for f, b, d, n, ids in zip(part.column("file").to_pylist(), part.column("block").to_pylist(),
                                           docs, counts, found):
                    ends = np.cumsum(n)
                    data = ids.astype("<u4").tobytes()
                    for s, e in zip((ends - n).tolist(), ends.tolist()):
                        one = data[4 * s:4 * e]
                        crcs.append(crc(one))
                        if with_ids:
                            raw.append(one)
                    file += [f] * len(n)
                    block += [b] * len(n)
                    rel += (ends - n).tolist()
                    sizes += n.tolist()
                    keys.append(d.values.field("doc_id"))
                cols = [pa.array(file, pa.int32()), pa.array(block, pa.int64()), pa.concat_arrays(keys),
                        pa.array(rel, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())]
                names = ["file", "block", "doc_id", "rel", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(raw, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    kind = stored.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()
    rows = stored.mapInArrow(unpack, f"file int, block bigint, doc_id {kind}, rel bigint, n_tokens bigint, "
                                     "ids_crc32 bigint" + (", ids binary" if with_ids else ""))
    return rows.join(starts, ["file", "block"]).select(
        "doc_id", (F.col("start") + F.col("rel")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def round_trip(docs: DataFrame, tokenizer: str, *, path: str | None = None, end_id: int = 2,
               max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files (in the shared folder if no ``path`` is given) and read them back."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id=end_id, max_bits=max_bits, id_col=id_col, text_col=text_col)
    return read_tokens(spark, path)
