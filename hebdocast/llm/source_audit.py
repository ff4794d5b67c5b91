"""Divergence of sources: how far each (language, source) departs from its language and from other sources.

Terms are runs of letters, ASCII lower-cased. Each language keeps the terms of at least ``min_docs`` of its
documents; p is the smoothed share of a term in a group, in billionths, and all arithmetic is exact.

Method: in a task, texts are cut into shards. A shard's pointers are the word starts in its Arrow buffer; they
are sorted by a multikey quicksort over eight-byte digits, whose slices (equal so far, not at their end) are
ordered by the next digit. Equal runs are the terms; within a run the pointers fall into documents and
groups, which gives counts and document frequencies. The runs of all shards are added up by Spark.

Scale: texts are read once, without a shuffle; what moves is a row per (group, term, shard), summed before the
shuffle too, so neither a group with a third of all rows nor a term of all documents is a large key. Pairs of
sources are compared by slices of terms and blocks of sources, as dense matrices of bounded size. A pair's
value over all terms is its value where both counts are zero, times all terms, plus corrections of the terms
that one of them has; a slice sends one correction a pair.

Defined results: null text, lang and source read as ''; every row is a document, repeated rows count each; groups
without terms have count 0 everywhere; languages without kept terms give pairs of value 0; an empty table gives
no rows. Very long terms and texts are whole terms and texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, worker_for, written

SHARD = 1 << 22  # bytes of text sorted at once; a longer text is a shard of its own
DIGITS = 8  # levels of the quicksort; what still is equal after 64 bytes is compared as a whole
SLICE_TERMS, BLOCK_SOURCES = 2_048, 128
BILLION = 1_000_000_000
_FOLD = np.zeros(256, np.uint8)  # letters, lower-cased; 0 elsewhere
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_MASK = np.array([0] + [(2**64 - 1) ^ (2**(64 - 8 * k) - 1) for k in range(1, 9)], np.uint64)
COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def word_starts(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms of folded bytes; no term crosses a bound."""
    inside = text != 0
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[bounds[:-1][bounds[:-1] < len(text)]] = False
    last = bounds[1:] - 1
    after[last[last >= 0]] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def multikey_sort(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pointers by their terms, and the first place of every equal run in it."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    windows = np.ndarray(len(text) + 1, ">u8", padded, strides=(1,))

    def digit(which, level):
        left = np.clip(ends[which] - starts[which] - 8 * level, 0, 8)
        at = np.minimum(starts[which] + 8 * level, len(text))
        return windows[at].astype(np.uint64) & _MASK[left]

    key = digit(slice(None), 0)
    order = np.argsort(key)
    new = np.ones(len(order), bool)
    ordered = key[order]
    new[1:] = ordered[1:] != ordered[:-1]
    longer = ends - starts > 8
    for level in range(1, DIGITS + 1):
        # slices that are equal so far and hold terms that go on
        run = np.cumsum(new) - 1
        sizes = np.bincount(run)
        going = np.bincount(run, weights=longer[order]) > 0
        places = np.flatnonzero(((sizes > 1) & going)[run])
        if not len(places):
            break
        which, slices = order[places], run[places]
        if level < DIGITS:
            key = digit(which, level)
            moved = np.lexsort((key, slices))
            key = key[moved]
            differs = key[1:] != key[:-1]
        else:
            rest = [text[s:e].tobytes() for s, e in zip(starts[which], ends[which])]
            moved = np.array(sorted(range(len(rest)), key=lambda i: (slices[i], rest[i])))
            differs = np.array([rest[i] != rest[j] for i, j in zip(moved[1:], moved[:-1])], bool)
        order[places] = which[moved]
        # the slices stay where they are: only starts within them are added
        new[places[1:][differs]] = True
        longer = ends - starts > 8 * (level + 1)
    return order, np.flatnonzero(new)


def shard_counts(raw: np.ndarray, bounds: np.ndarray, group: np.ndarray, groups: int):
    """Terms of a shard as bytes with offsets, and for each (term, group): term, group, places, documents."""
    text = _FOLD[raw]
    starts, ends = word_starts(text, bounds)
    if not len(starts):
        return None
    order, first = multikey_sort(text, starts, ends)
    run = np.zeros(len(order), np.int64)
    run[first] = 1
    run = np.cumsum(run) - 1
    # documents of a run, each once with its number of places
    n_docs = len(bounds) - 1
    doc = np.searchsorted(bounds, starts, side="right") - 1
    pair = np.sort(run * n_docs + doc[order])
    edge = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    places = np.diff(np.append(edge, len(pair)))
    cell = pair[edge] // n_docs * groups + group[pair[edge] % n_docs]
    by = np.argsort(cell, kind="stable")
    cell, places = cell[by], places[by]
    at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    counts, docs = np.add.reduceat(places, at), np.diff(np.append(at, len(cell)))
    # the bytes of each distinct term
    begin, length = starts[order[first]], (ends - starts)[order[first]]
    offsets = np.concatenate([[0], np.cumsum(length)])
    chars = text[np.repeat(begin - offsets[:-1], length) + np.arange(offsets[-1])]
    return chars, offsets, cell[at] // groups, cell[at] % groups, counts, docs


def _shards(text: pa.Array):
    """Slices of an Arrow binary array of about ``SHARD`` bytes: first row, bytes, bounds of its texts."""
    wide = pa.types.is_large_binary(text.type)
    offsets = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)[text.offset:text.offset + len(text) + 1].astype(np.int64)
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SHARD, side="right")) - 1)
        yield at, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def _count_terms(batches):
    worker_for("terms")
    for batch in batches:
        if not batch.num_rows:
            continue
        names = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"])
        seen = {}
        group = np.array([seen.setdefault((x["lang"], x["source"]), len(seen)) for x in names.to_pylist()], np.int64)
        langs, sources = (pa.array([g[i] for g in seen], pa.string()) for i in (0, 1))
        # a row a group, with or without terms
        none = pa.array(np.zeros(len(seen), np.int64))
        yield pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(seen), pa.string()), none, none], names=["lang", "source", "term", "n", "docs"])
        for at, raw, bounds in _shards(batch.column("text")):
            found = shard_counts(raw, bounds, group[at:at + len(bounds) - 1], len(seen))
            if found is not None:
                chars, offsets, term, who, counts, docs = found
                terms = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(chars)).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(who)), sources.take(pa.array(who)), terms.take(pa.array(term)), pa.array(counts), pa.array(docs)],
                    names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, docs`` of every group, and for every group one row whose term is null."""
    named = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))]
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("text")
    return docs.select(*named, text).mapInArrow(_count_terms, COUNTS).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column, smooth: int) -> Column:
    """1 + floor(10^9 (n + smooth) / (total + smooth * kept)), exactly."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1).cast("bigint") + F.call_function("div", wide(n + F.lit(smooth)) * F.lit(BILLION).cast("decimal(10,0)"),
                                                     wide(total + F.lit(smooth) * kept))


def _pair_sums(table: pa.Table) -> pa.Table:
    """Corrections of the pairs of a block of sources over a slice of terms. Rows with a null term give each
    source's share at count 0; the block's others are shares of single terms."""
    term, source = table.column("term").combine_chunks(), table.column("source").combine_chunks()
    share_ = table.column("p").to_numpy()
    head = term.is_null().to_numpy(zero_copy_only=False)
    names = source.filter(pa.array(head))
    base, half = share_[head], table.column("half").to_numpy()[head]
    one_block = table.column("low")[0].as_py() == table.column("high")[0].as_py()
    n = len(base)
    who = np.asarray(pa.compute.index_in(source, names).to_numpy(zero_copy_only=False)).astype(np.int64)
    what = term.filter(pa.array(~head)).dictionary_encode()
    width = len(what.dictionary)
    matrix = np.repeat(base[:, None], width, 1)
    matrix[who[~head], what.indices.to_numpy()] = share_[~head]
    first = table.column("slice").to_numpy()[0] == 0
    times = (table.column("terms").to_numpy()[0] if first else 0) - width
    left, right, value = [], [], []
    for s in range(n):
        # pairs of two blocks: left from the first, right from the second; within one block each once
        others = np.arange(s + 1, n) if one_block else np.flatnonzero(half == 1)
        if half[s] == 1 or not len(others):
            continue
        left.append(np.full(len(others), s))
        right.append(others)
        value.append(np.abs(matrix[others] - matrix[s]).sum(1) + times * np.abs(base[others] - base[s]))
    none = [np.empty(0, np.int64)]
    pick = lambda k: names.take(pa.array(np.concatenate(k or none)))
    total = np.concatenate(value or none)
    return pa.table([pa.repeat(table.column("lang")[0], len(total)), pick(left), pick(right), pa.array(total)],
                    names=["lang", "a", "b", "value"])


def divergence(docs: DataFrame, *, min_docs: int = 30, smooth: int = 5, top: int = 50, text_col: str = "text",
               lang_col: str = "lang", source_col: str = "source", slice_terms: int = SLICE_TERMS,
               block_sources: int = BLOCK_SOURCES) -> DataFrame:
    """``lang, source, part, item, value, rank``: for each group its distance to the other sources of its language
    (part ``pair``) and the ``top`` terms that it has more of than its language (part ``term``)."""
    counts = written(term_counts(docs, text_col=text_col, lang_col=lang_col, source_col=source_col), "terms")
    often = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("lang_docs"))
    often = written(often.filter(F.col("lang_docs") >= min_docs).drop("lang_docs"), "often")
    kept = written(counts.filter("term is not null").drop("docs").join(often, ["lang", "term"]), "kept-terms")
    # a row a group and a row a language
    groups = counts.filter("term is null").select("lang", "source").join(
        kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    langs = often.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    sources = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    zero = F.lit(0).cast("bigint")
    groups = written(groups.join(sources, "lang").join(langs, "lang", "left").select(
        "lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("terms", zero).alias("terms"),
        F.coalesce("lang_total", zero).alias("lang_total"), F.ceil(F.col("sources") / block_sources).alias("blocks"),
        F.greatest(F.lit(1).cast("bigint"), F.ceil(F.coalesce("terms", zero) / slice_terms)).alias("slices")), "groups")
    discard(counts, often)

    shares = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms"), smooth))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"), smooth)
    terms = shares.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - q).alias("value")).filter("value > 0")

    slices = F.pmod(F.xxhash64("term"), F.col("slices"))
    base = F.when(F.col("terms") > 0, share(zero, F.col("total"), F.greatest(F.col("terms"), F.lit(1)), smooth)).otherwise(zero)
    heads = groups.withColumn("p", base).withColumn("slice", F.explode(F.sequence(zero, F.col("slices") - 1)))
    cells = heads.withColumn("term", F.lit(None).cast("string")).unionByName(shares.withColumn("slice", slices), allowMissingColumns=True)
    # a source meets every block, in the place (0 or 1) that its own block has beside it
    block = F.pmod(F.xxhash64("source"), F.col("blocks"))
    cells = cells.select("lang", "source", "term", "p", "slice", "terms", block.alias("block"),
                         F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("other"))
    keys = ["lang", "slice", "low", "high"]
    cells = cells.select("lang", "source", "term", "p", "slice", "terms", F.least("block", "other").alias("low"),
                         F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).cast("int").alias("half"))
    sums = cells.groupBy(*keys).applyInArrow(_pair_sums, "lang string, a string, b string, value bigint").groupBy("lang", "a", "b").agg(
        F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                             F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = sums.select("lang", "value", both.alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(terms).filter(F.col("rank") <= top).unionByName(ranked(pairs)).select("lang", "source", "part", "item", "value", "rank")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
                                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
l AS (SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS terms FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(total, 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d)
      LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) USING (lang, source)),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
       1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.terms) AS p,
       1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.terms) AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS v FROM p a JOIN p b USING (lang, term)
      WHERE a.source <> b.source GROUP BY ALL),
f AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q
      UNION ALL SELECT a.lang, a.source, 'pair', b.source, coalesce(x.v, 0)::BIGINT FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM f)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 50
"""
