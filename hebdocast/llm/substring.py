"""Repeated word windows, found by level-wise doubling.

Words are compared unchanged. A window of ``size`` words can only stand twice if shorter windows
inside it do, so the search starts at a quarter of its length and doubles: windows repeated at one
length alone are looked at again at twice that length, until the full length, or until none is left.

At the lengths below ``size`` not every window is compared. Each full window is represented by the
smallest hash among the short windows inside it; equal full windows have equal representatives, so
nothing is lost, and neighbours share theirs, so only a tenth of the short windows move. A full
window stays a candidate while its representative is repeated somewhere. At the second length,
neighbouring candidates with one representative form a stretch, and a stretch that is repeated as a
whole settles all of its windows at once; only stretches at the rims of repeated passages, with one
copy of those that they may equal, are listed window by window at the full length. Stretches and full
windows are compared by 128 bits.

Scale: texts are read twice and shuffled once, to pick the documents that have candidates. Counts are
aggregated before each shuffle and written before they are joined back, so a passage in a third of
all rows is counted where it stands and the join's large side can be split.

Defined results: a null text has no words; a null id is kept; windows of repeated rows (same id and
text) repeat each other, and each such row gives one row; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_type, keyed, written
from .words import mix, multipliers, runs, text_words


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours."""
    n, step = len(values) - width + 1, 1
    best = values
    while 2 * step <= width:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    return np.minimum(best[:n], best[width - step:width - step + n])


def representatives(short: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Representative of every full window, and the positions of short windows that represent one."""
    least = sliding_min(short, width)
    rim = np.zeros(width - 1, np.uint64)
    most = ~sliding_min(~np.concatenate([rim, least, rim]), width)
    return least, np.flatnonzero(most == short)


def first_level(texts: DataFrame, size: int, length: int, kind: str) -> DataFrame:
    """One row a document: ``doc_id, k1, k2, n_words, kept_sha256`` (of all words) and ``anchors``,
    the hashes of its representing windows of ``length`` words."""

    def run(batches):
        factors = multipliers(length, f"window{length}-")
        for batch in batches:
            counts, shas, anchors = [], [], []
            texts = batch.column("text")
            for row, raw, starts, ends, h in text_words(texts, lower=False):
                counts.append(len(h))
                shas.append(hashlib.sha256(b" ".join((texts[row].as_py() or b"").split())).hexdigest())
                if len(h) < size:
                    anchors.append(None)
                    continue
                short = runs(h, length, factors)
                anchors.append(short[representatives(short, size - length + 1)[1]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array(counts, pa.int64()),
                 pa.array(shas), pa.array(anchors, pa.list_(pa.int64()))],
                ["doc_id", "k1", "k2", "n_words", "kept_sha256", "anchors"])

    return texts.mapInArrow(run, f"doc_id {kind}, k1 bigint, k2 bigint, n_words bigint, kept_sha256 string, "
                                 "anchors array<bigint>")


def stretches(alive: DataFrame, size: int, lengths: tuple[int, int]) -> DataFrame:
    """Stretches of candidate windows: ``row, gram, whole, at, n, twice``: the representative at the
    second length, the hash of all words of the stretch, its first window and number of windows, and
    whether the representative stands more than once in this document."""

    def run(batches):
        short_by, long_by = (multipliers(k, f"window{k}-") for k in lengths)
        for batch in batches:
            out = [[] for _ in range(6)]
            rows, found = batch.column("row").to_numpy(), batch.column("found")
            for row, _, _, _, h in text_words(batch.column("text"), lower=False):
                least, _ = representatives(runs(h, lengths[0], short_by), size - lengths[0] + 1)
                live = np.flatnonzero(np.isin(least, found[row].values.to_numpy().view(np.uint64)))
                if not len(live):
                    continue
                gram, spots = representatives(runs(h, lengths[1], long_by), size - lengths[1] + 1)
                grams = gram[live]
                cut = np.flatnonzero((np.diff(live) != 1) | (grams[1:] != grams[:-1])) + 1
                first, last = live[np.concatenate([[0], cut])], live[np.concatenate([cut - 1, [len(live) - 1]])]
                n = last - first + 1
                standing, times = np.unique(runs(h, lengths[1], long_by)[spots], return_counts=True)
                twice = np.isin(gram[first], standing[times > 1])
                for k, part in enumerate((np.full(len(first), rows[row]), gram[first].view(np.int64),
                                          whole_hashes(h, first, n + size - 1).view(np.int64), first, n, twice)):
                    out[k].append(part)
            cols = [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                 pa.array(cols[3].astype(np.int32)), pa.array(cols[4].astype(np.int32)),
                 pa.array(cols[5].astype(bool))], ["row", "gram", "whole", "at", "n", "twice"])

    return alive.mapInArrow(run, "row bigint, gram bigint, whole bigint, at int, n int, twice boolean")


def whole_hashes(h: np.ndarray, first: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hash of the words ``first`` to ``first + words`` for every stretch."""
    out = np.empty(len(first), np.uint64)
    raw = h.tobytes()
    for i, (a, n) in enumerate(zip(first.tolist(), words.tolist())):
        out[i] = int.from_bytes(hashlib.blake2b(raw[8 * a:8 * (a + n)], digest_size=8).digest(), "little")
    return out


def full_windows(alive: DataFrame, size: int) -> DataFrame:
    """``row, at, h1, h2`` of every window in the stretches ``spans`` (array of at, n)."""

    def run(batches):
        one, two = multipliers(size, "full-a"), multipliers(size, "full-b")
        for batch in batches:
            out = [[] for _ in range(4)]
            rows, spans = batch.column("row").to_numpy(), batch.column("spans")
            for row, _, _, _, h in text_words(batch.column("text"), lower=False):
                values = spans[row].values
                at = covered(values.field("at").to_numpy(), values.field("n").to_numpy(), len(h) - size + 1)
                for k, part in enumerate((np.full(len(at), rows[row]), at, runs(h, size, one)[at].view(np.int64),
                                          runs(mix(h), size, two)[at].view(np.int64))):
                    out[k].append(part)
            cols = [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1].astype(np.int32)),
                 pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["row", "at", "h1", "h2"])

    return alive.mapInArrow(run, "row bigint, at int, h1 bigint, h2 bigint")


def covered(at: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Positions below ``size`` inside any of the spans ``at`` to ``at + n``."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + n, size), -1)
    return np.flatnonzero(np.cumsum(step[:-1]) > 0)


def removed(alive: DataFrame, size: int, with_text: bool) -> DataFrame:
    """``k1, k2, n_removed, cut_sha256`` (and ``kept``) of the documents with repeated ``spans``."""

    def run(batches):
        for batch in batches:
            gone, shas, kept = [], [], []
            texts, spans = batch.column("text"), batch.column("spans")
            for row in range(len(texts)):
                words = texts[row].as_py().split()
                values = spans[row].values
                cut = covered(values.field("at").to_numpy(), values.field("n").to_numpy() + size - 1, len(words))
                keep = np.ones(len(words), bool)
                keep[cut] = False
                left = b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])
                gone.append(len(cut))
                shas.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            cols = [batch.column("k1"), batch.column("k2"), pa.array(gone, pa.int64()), pa.array(shas, pa.string())]
            names = ["k1", "k2", "n_removed", "cut_sha256"]
            if with_text:
                cols.append(pa.array(kept, pa.binary()).cast(pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(cols, names)

    return alive.mapInArrow(run, "k1 bigint, k2 bigint, n_removed bigint, cut_sha256 string"
                            + (", kept string" if with_text else ""))


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys that stand in two rows or more."""
    return written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"), "repeated")


def cuts(docs: DataFrame, *, size: int, id_col: str, text_col: str, with_text: bool) -> tuple[DataFrame, DataFrame]:
    """``doc_id, k1, k2, n_words, kept_sha256`` of every row as it came, and ``k1, k2, n_removed,
    cut_sha256`` (and ``kept``) of the distinct documents that lose words."""
    if size < 4:
        raise ValueError("windows need four words at least")
    kind = id_type(docs, id_col)
    lengths = (-(-size // 4), 2 * -(-size // 4))
    texts = keyed(docs, id_col, text_col)
    # Documents are numbered once, in a stored table; the later reading of the texts finds their
    # numbers by two hashes of id and text.
    first = written(first_level(texts, size, lengths[0], kind)
                    .withColumn("row", F.monotonically_increasing_id()), "first")
    anchors = first.filter("anchors is not null").select("row", F.explode("anchors").alias("gram"))
    again = anchors.join(repeated(anchors, "gram").hint("merge"), "gram", "left_semi")
    live = again.groupBy("row").agg(F.collect_set("gram").alias("found"))
    # Rows that repeat an id and text share one number but stay rows: their windows count each.
    live = first.select("row", "k1", "k2").join(live.hint("merge"), "row").groupBy("k1", "k2").agg(
        F.min("row").alias("row"), F.first("found").alias("found"))
    alive = written(texts.select("k1", "k2", "text").join(written(live, "live").hint("shuffle_hash"), ["k1", "k2"]),
                    "alive", compression="zstd")

    spans = stretches(alive.select("row", "text", "found"), size, lengths).withColumn(
        "rid", F.xxhash64("row", "at"))
    spans = written(spans, "stretches")
    wholes = written(spans.groupBy("gram", "whole").agg(
        F.count(F.lit(1)).alias("n_whole"), F.min("rid").alias("first_rid"),
        F.max(F.col("twice").cast("int")).alias("twice")), "wholes")
    grams = written(wholes.groupBy("gram").agg(F.sum(F.col("n_whole") + F.col("twice")).alias("n_gram"),
                                               F.min("n_whole").alias("low")).filter("n_gram > 1"), "grams")
    known = written(wholes.join(grams.hint("merge"), "gram").select("gram", "whole", "n_whole", "first_rid", "low"),
                    "known")
    judged = written(spans.join(known.hint("merge"), ["gram", "whole"]).select(
        "row", "at", "n", (F.col("n_whole") > 1).alias("settled"),
        ((F.col("low") == 1) & ((F.col("n_whole") == 1) | (F.col("rid") == F.col("first_rid")))).alias("open")),
        "judged")
    span = F.collect_set(F.struct("at", "n")).alias("spans")
    open_spans = judged.filter("open").groupBy("row").agg(span)
    texts_of = alive.select("row", "text")
    windows = written(full_windows(texts_of.join(open_spans.hint("shuffle_hash"), "row"), size), "windows")
    twins = windows.join(repeated(windows, "h1", "h2").hint("merge"), ["h1", "h2"], "left_semi")
    marks = judged.filter("settled").select("row", "at", "n").union(
        twins.select("row", "at", F.lit(1).alias("n"))).groupBy("row").agg(span)
    cut = removed(alive.select("row", "k1", "k2", "text").join(marks.hint("shuffle_hash"), "row"), size, with_text)
    cut = written(cut.dropDuplicates(["k1", "k2"]), "cut", compression="zstd")
    discard(spans, wholes, grams, known, judged, windows, alive)
    return first.drop("anchors", "row"), cut


def substring_dedup(docs: DataFrame, *, size: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Without the words that lie in a window of ``size`` words whose words also start elsewhere:
    ``doc_id, n_words, n_removed, kept_sha256`` (of the words left, joined by one space) of every row."""
    first, cut = cuts(docs, size=size, id_col=id_col, text_col=text_col, with_text=False)
    return first.join(cut.hint("merge"), ["k1", "k2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"),
        F.coalesce("cut_sha256", "kept_sha256").alias("kept_sha256"))


def without_repeats(docs: DataFrame, *, size: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all columns; a text that loses words becomes its words left, joined by one space."""
    _, cut = cuts(docs, size=size, id_col=id_col, text_col=text_col, with_text=True)
    cut = cut.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("kept").alias("_kept"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    return (docs.withColumn("_k1", F.xxhash64(text)).withColumn("_k2", F.xxhash64(F.lit(1), F.col(f"`{id_col}`"), text))
            .join(cut.hint("shuffle_hash"), ["_k1", "_k2"], "left")
            .withColumn(text_col, F.coalesce("_kept", F.col(f"`{text_col}`"))).select(*[f"`{c}`" for c in docs.columns]))
