"""Best-fit packing of token pieces under several capacities at once.

A sequence has three capacities: tokens, documents (pieces) and attention cost (the sum of squared
piece lengths). Pieces are placed in falling order of length. Among the open sequences that can take
a piece under *every* capacity, the one with the smallest weighted norm of what would be left
(``rule="norm"``) or with the largest weighted dot product of the piece with what is left
(``rule="dot"``) takes it; without any, a new sequence opens. All quantities are shares of the
capacity, so the weights compare like with like.

Scale: texts become pieces in one pass over the scan, without a shuffle. Only the pieces' keys and
lengths are then dealt at random into groups of about ``GROUP`` pieces, whatever their documents,
sources or lengths, and each group is packed in one task. A group loses about one part-filled
sequence in thousands, and no task grows with the input.

Defined results: a null text is empty, and an empty text is one piece with the end id alone; a null
id is kept; repeated rows are packed as often as they stand; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, pick, written
from .tokens import crc, tokens

GROUP = 20_000


def token_pieces(docs: DataFrame, tokenizer: str, *, max_tokens: int = 4096, end_id: int = 1,
                 id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every text: ``doc_id, piece, start, length, ids_crc32`` and, on request, ``ids``
    (binary, little-endian unsigned 32-bit). Only texts beyond ``max_tokens`` are cut."""
    end = int(end_id).to_bytes(4, "little")
    step = 4 * max_tokens

    def cut(batches):
        table = tokens(tokenizer)
        for batch in batches:
            take, piece, start, length, crcs, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                table.trim()
                whole = table.ids(text.as_py()) + end
                for k, at in enumerate(range(0, len(whole), step)):
                    part = whole[at:at + step]
                    take.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crcs.append(crc(part))
                    if with_ids:
                        ids.append(part)
            cols = [batch.column(0).take(pa.array(take, pa.int32())), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crcs, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = (f"doc_id {id_type(docs, id_col)}, piece int, start bigint, length bigint, ids_crc32 bigint"
              + (", ids binary" if with_ids else ""))
    return pick(docs, id_col, text_col).mapInArrow(cut, schema)


def place(lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float],
          rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of every piece of one group. Ties go to the sequence opened first."""
    cap = np.array(capacity, float)
    size = np.stack([lengths, np.ones_like(lengths), lengths * lengths], 1).astype(float)
    share, w = size / cap, np.array(weights, float)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left = np.empty((3, 1024))  # what each open sequence still takes, as shares
    name, filled = np.empty(1024, np.int64), np.zeros(1024, np.int64)
    n_open = made = 0
    least = share.min(0)
    slack = 0.25 / cap  # half of half a unit: rounding never decides what fits
    for i in order:
        item = share[i]
        room = left[:, :n_open] - item[:, None]
        fits = np.flatnonzero((room >= -slack[:, None]).all(0))
        if len(fits):
            if rule == "dot":
                at = fits[np.argmax((w * item) @ left[:, fits])]
            else:
                at = fits[np.argmin(w @ (room[:, fits] ** 2))]
        else:
            if n_open == left.shape[1]:
                left = np.concatenate([left, np.empty_like(left)], 1)
                name, filled = np.concatenate([name, name]), np.concatenate([filled, filled])
            at, n_open = n_open, n_open + 1
            left[:, at], name[at], filled[at] = 1.0, made, 0
            made += 1
        bins[i], offsets[i] = name[at], filled[at]
        filled[at] += lengths[i]
        left[:, at] -= item
        if (left[:, at] < least - slack).any():  # nothing that may still come fits
            n_open -= 1
            left[:, at:n_open] = left[:, at + 1:n_open + 1]
            name[at:n_open], filled[at:n_open] = name[at + 1:n_open + 1], filled[at + 1:n_open + 1]
    return bins, offsets


def pack(pieces: DataFrame, *, max_tokens: int = 4096, max_docs: int | None = None,
         max_cost: int | None = None, weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
         rule: str = "norm", group: int = GROUP) -> DataFrame:
    """``pieces`` plus ``sequence_id`` and ``offset``. ``pieces`` holds a ``length`` column (1 to
    ``max_tokens``) and must be a stored table (see :func:`common.written`): it is dealt by row.
    Without ``max_docs`` or ``max_cost`` those capacities are as large as ``max_tokens`` allows."""
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule}")
    capacity = (max_tokens, max_docs or max_tokens, max_cost or max_tokens ** 2)
    groups = max(1, -(-pieces.count() // group))

    def fill(table):
        lengths = table.column("length").to_numpy().astype(np.int64)
        worst = lengths.max(initial=0)
        if worst > capacity[0] or worst * worst > capacity[2] or lengths.min(initial=1) < 1:
            raise ValueError("a piece is empty or larger than a sequence's capacity")
        bins, offsets = place(lengths, capacity, weights, rule)
        first = table.column("_group")[0].as_py() << 32
        return (table.drop_columns(["_group"]).append_column("sequence_id", pa.array(bins + first))
                .append_column("offset", pa.array(offsets)))

    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy("_group").applyInArrow(fill, f"{schema}, sequence_id bigint, offset bigint")


def packed(docs: DataFrame, tokenizer: str, *, max_tokens: int = 4096, end_id: int = 1,
           id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """Documents to placed pieces: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    pieces = token_pieces(docs, tokenizer, max_tokens=max_tokens, end_id=end_id, id_col=id_col,
                          text_col=text_col)
    return pack(written(pieces, "pieces"), max_tokens=max_tokens, **limits)


def sequences(docs: DataFrame, tokenizer: str, *, max_tokens: int = 4096, end_id: int = 1,
              id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The packed training rows: ``sequence_id, n_tokens, ids`` (binary, at most ``max_tokens``
    little-endian unsigned 32-bit ids), pieces joined in the order of their offsets."""
    pieces = written(token_pieces(docs, tokenizer, max_tokens=max_tokens, end_id=end_id, id_col=id_col,
                                  text_col=text_col, with_ids=True), "pieces")
    placed = pack(pieces, max_tokens=max_tokens, **limits)
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most max_tokens pieces
    return (placed.groupBy("sequence_id")
            .agg(F.sum("length").alias("n_tokens"), rows.alias("rows"))
            .select("sequence_id", "n_tokens",
                    F.aggregate("rows", F.lit(b""), lambda a, r: F.concat(a, r["ids"])).alias("ids")))
