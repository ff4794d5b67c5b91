"""Exact top-k by inner product over an impact-ordered index.

Components become integers, ``floor(scale * x)``. Rows are dealt into blocks of about ``BLOCK_ROWS``; in a
block every dimension has postings (rows and values, ordered by value) cut into segments of neighbouring
values. A query orders all segments by the largest product that they may hold, its impact, and adds
their products to the rows' scores from the highest impact down. At a few points, and at the latest when
no segment with a positive impact is left, the sum of what each dimension may still add bounds every
row from above. The best rows so far are scored exactly, and once only few rows can still beat the k-th
of them, that proof ends the scan: every row that may belong to the answer is scored exactly.

Scale: queries are a share of the rows, so the work is their product; a task holds one block and at most
``QUERIES`` queries, whatever the input. Each block sends at most k rows a query to the final ranking.

Defined results: vectors that are null, empty or hold null or non-finite components, and rows without an
id, take no part; rows that repeat id and vector count once; only vectors of equal length meet; ties go to
the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK_ROWS = 16_384
QUERIES = 4_096
SEGMENTS = 16  # a dimension
CHECKS = 8  # attempts at a proof
FEW = 256  # rows that are scored exactly rather than bounded further


class Block:
    """Impact-ordered postings of a block of integer vectors (rows x dimensions)."""

    def __init__(self, values: np.ndarray):
        self.values = values
        n, dims = values.shape
        order = np.argsort(values, axis=0, kind="stable")
        self.rows = np.ascontiguousarray(order.T)
        self.sorted = np.ascontiguousarray(np.take_along_axis(values, order, 0).T)
        cuts = np.unique(np.linspace(0, n, min(SEGMENTS, n) + 1).astype(np.int64))
        self.start, self.end = cuts[:-1], cuts[1:]
        self.low = self.sorted[:, self.start]
        self.high = self.sorted[:, self.end - 1]

    def search(self, q: np.ndarray, k: int, skip: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the ``k`` best rows outside ``skip``, best first, ties by id."""
        impact = np.maximum(q[:, None] * self.low, q[:, None] * self.high)
        dim, part = np.unravel_index(np.argsort(-impact, axis=None, kind="stable"), impact.shape)
        impacts = impact[dim, part]
        positive = int(np.searchsorted(-impacts, 0, side="left"))
        score = np.zeros(len(self.values), np.int64)
        score[skip] = np.iinfo(np.int64).min // 2
        # What a dimension may still add is its best segment left, or nothing.
        left = np.sort(np.where(impact > 0, impact, 0), axis=1)[:, ::-1]
        used = np.zeros(len(q), np.int64)
        stops = sorted({positive * (c + CHECKS) // (2 * CHECKS) for c in range(1, CHECKS + 1)} | {positive})
        at = 0
        for stop in stops:
            for d, p in zip(dim[at:stop].tolist(), part[at:stop].tolist()):
                s = slice(self.start[p], self.end[p])
                score[self.rows[d, s]] += q[d] * self.sorted[d, s]
            used += np.bincount(dim[at:stop], minlength=len(q))
            at = stop
            rest = int(sum(left[d, u] for d, u in enumerate(used.tolist()) if u < left.shape[1]))
            seeds = np.argpartition(-score, min(4 * k, len(score) - 1))[:4 * k]
            exact = self.exact(q, seeds, skip)
            kth = np.sort(exact)[::-1][min(k, len(exact)) - 1]
            may = np.flatnonzero(score + rest >= kth)
            if len(may) <= FEW or stop == positive:
                break
        exact = self.exact(q, may, skip)
        best = np.lexsort((ids[may], -exact))[:k]
        best = best[exact[best] > np.iinfo(np.int64).min // 4]
        return may[best], exact[best]

    def exact(self, q: np.ndarray, rows: np.ndarray, skip: np.ndarray) -> np.ndarray:
        out = self.values[rows] @ q
        out[np.isin(rows, skip)] = np.iinfo(np.int64).min // 2
        return out


def integers(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` (array<bigint>) of the rows that take part."""
    v = F.col(f"`{vector_col}`")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(v.isNotNull() & (F.size(v) > 0) & fine & F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("bigint").alias("vec_id"),
        F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v")).dropDuplicates()


def exact_top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: int = 256, block_rows: int = BLOCK_ROWS,
                queries: int = QUERIES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``is_query`` (a condition on ``vec_id``)
    selects, the ``k`` rows of other ids with the highest integer inner products."""
    rows = written(integers(vectors, scale, id_col, vector_col).withColumn("d", F.size("v")), "vectors")
    asked = rows.filter(is_query)
    sizes = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    n_blocks, n_parts = max(1, -(-sizes[0] // block_rows)), max(1, -(-sizes[1] // queries))
    numbered = F.xxhash64(F.monotonically_increasing_id())
    dealt = rows.withColumn("block", F.pmod(numbered, F.lit(n_blocks))).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_parts - 1).cast("bigint"))))
    meeting = asked.withColumn("part", F.pmod(numbered, F.lit(n_parts))).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))))

    def matrix(table):
        flat = table.column("v").combine_chunks()
        return np.asarray(flat.flatten()).reshape(table.num_rows, -1)

    def search(left, right):
        found = [[], [], []]
        if left.num_rows and right.num_rows:
            ids = left.column("vec_id").to_numpy()
            by_id = np.argsort(ids, kind="stable")
            ordered = ids[by_id]
            block = Block(matrix(left))
            for query_id, q in zip(right.column("vec_id").to_pylist(), matrix(right)):
                own = by_id[slice(*np.searchsorted(ordered, [query_id, query_id + 1]))]
                rows, scores = block.search(q, k, own, ids)
                found[0].append(np.full(len(rows), query_id))
                found[1].append(ids[rows])
                found[2].append(scores)
        none = np.empty(0, np.int64)
        return pa.table([np.concatenate(x or [none]).astype(np.int64) for x in found],
                        names=["query_id", "vec_id", "score"])

    keys = ["d", "block", "part"]
    best = dealt.groupBy(*keys).cogroup(meeting.groupBy(*keys)).applyInArrow(
        search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
             vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
