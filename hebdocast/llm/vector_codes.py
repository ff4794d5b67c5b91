"""Product-quantised codes of vectors: k-means codebooks a part, assigned under norm-of-sum bounds.

Components become integers, ``floor(scale * x)``; vectors are cut into equal parts and every part position
has a codebook. A round assigns each part to its nearest entry and moves the entries to the floored means.
All distances and sums are integers, so rounds don't depend on the order of rows.

Bounds: every (vector, part, entry) keeps a lower bound of its distance, as measured in the round of its
stamp. The codebooks of all rounds are kept, so an entry's *net* displacement since that stamp (the norm
of the sum of its moves, never more than the sum of their norms) is known exactly; taken off the bound,
it tells whether the entry can still be as near as the assigned one. The assigned entry's own bound and
net displacement give the upper bound. Only where they leave a doubt is the assigned distance measured
anew, and only entries that then still are in doubt are rescanned exactly.

Scale: one pass over the vectors a round. Vectors carry their bounds (two bytes) and stamps (one byte) in
a table that replaces the one of the round before; a task adds what its vectors take from and bring to
the entries as one row of that same table, so a retried task counts once. The driver holds the codebooks of
all rounds (entries x dimensions integers each), which don't grow with the rows.

Defined results: rows whose vector is null or holds null or non-finite components are dropped; rows with
null ids stay and come last among the starting entries; repeated ids start in the order of their vectors;
with fewer rows than entries the codebooks have as many entries as rows; null labels are one label; an
empty table gives no rows. Vectors must have one length, a multiple of ``parts``, and components whose squared
distances fit a long; else a ValueError says so before any round.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

STATE = "vec_id {id}, label {label}, v array<bigint>, code binary, low binary, stamp binary, error bigint, sums array<bigint>"
CELLS = 1 << 20  # numbers of a step in a task
ABOVE, BELOW = 1 + 1e-9, 1 - 1e-9  # room for the rounding of square roots


def integers(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``vec_id, label, v`` (array<bigint>) of the rows that take part."""
    v = F.col(f"`{vector_col}`")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(v.isNotNull() & fine).select(
        F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"),
        F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis."""
    d = x - y
    return (d * d).sum(-1)


def net_displacement(history: list[np.ndarray]) -> np.ndarray:
    """Distance of every entry from its place in each earlier round: rounds x parts x entries."""
    now = history[-1]
    return np.stack([np.sqrt(squared(now, then).astype(np.float64)) for then in history]) * ABOVE


class Bounds:
    """Codes, lower bounds (in units, rounded down) and their round stamps, of a batch of vectors."""

    def __init__(self, code: np.ndarray, low: np.ndarray, stamp: np.ndarray, unit: float):
        self.code, self.low, self.stamp, self.unit = code, low, stamp, unit
        self.rescans = 0

    @classmethod
    def first(cls, v: np.ndarray, entries: np.ndarray, unit: float) -> "Bounds":
        """Every distance measured, in round 0."""
        n, parts, _ = v.shape
        d = np.empty((n, parts, entries.shape[1]), np.int64)
        for p in range(parts):
            for e in range(entries.shape[1]):
                d[:, p, e] = squared(v[:, p], entries[p, e])
        new = cls(d.argmin(2).astype(np.uint8), cls.down(d, unit), np.zeros(d.shape, np.uint8), unit)
        new.rescans = d.size
        return new

    @staticmethod
    def down(d: np.ndarray, unit: float) -> np.ndarray:
        return np.floor(np.sqrt(d.astype(np.float64)) * (BELOW / unit)).astype(np.uint16)

    def assign(self, v: np.ndarray, history: list[np.ndarray]) -> None:
        """Nearest entries of the last codebooks of ``history``, ties to the lower index."""
        now, round_ = history[-1], len(history) - 1
        n, parts, _ = v.shape
        entry = np.arange(now.shape[1])
        net = net_displacement(history)[self.stamp, np.arange(parts)[:, None], entry]
        low = self.low * self.unit - net
        own = self.code.astype(np.int64)[:, :, None]
        high = (np.take_along_axis(self.low, own, 2).astype(np.float64) + 1) * (self.unit * ABOVE) \
            + np.take_along_axis(net, own, 2)
        doubt = low <= high
        np.put_along_axis(doubt, own, False, 2)
        row, part = np.nonzero(doubt.any(2))
        if not len(row):
            return
        # the assigned distance, exactly: often that settles it
        mine = self.code[row, part]
        best = squared(v[row, part], now[part, mine])
        self._measured(row, part, mine, best, round_)
        open_ = doubt[row, part] & (low[row, part] <= np.sqrt(best.astype(np.float64))[:, None] * ABOVE)
        k, e = np.nonzero(open_)
        exact = squared(v[row[k], part[k]], now[part[k], e])
        self._measured(row[k], part[k], e, exact, round_)
        self.rescans += len(row) + len(k)
        table = np.full((len(row), len(entry)), np.iinfo(np.int64).max)
        table[k, e] = exact
        table[np.arange(len(row)), mine] = best
        self.code[row, part] = table.argmin(1)

    def _measured(self, row, part, e, d, round_) -> None:
        self.low[row, part, e] = self.down(d, self.unit)
        self.stamp[row, part, e] = round_


def moved(v: np.ndarray, old: np.ndarray | None, new: np.ndarray, entries: int) -> np.ndarray:
    """Counts and component sums that the entries win and lose: parts x entries x (1 + width)."""
    n, parts, width = v.shape
    out = np.zeros((parts, entries, 1 + width), np.int64)
    for p in range(parts):
        went = np.arange(n) if old is None else np.flatnonzero(old[:, p] != new[:, p])
        np.add.at(out[p, :, 0], new[went, p], 1)
        np.add.at(out[p, :, 1:], new[went, p], v[went, p])
        if old is not None:
            np.subtract.at(out[p, :, 0], old[went, p], 1)
            np.subtract.at(out[p, :, 1:], old[went, p], v[went, p])
    return out


def _slices(batches, cells: int):
    """Batches of at most ``CELLS`` numbers, whatever the length of the vectors."""
    each = max(1, CELLS // max(cells, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, each):
            yield batch.slice(at, each)


def _round(history: list[np.ndarray], unit: float, first: bool, last: bool):
    """Function of one round for ``mapInArrow``: the rows with new codes, and one row of sums."""
    parts, entries, width = history[-1].shape

    def blob(column, kind, n):
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, parts, -1).copy()

    def run(batches):
        total, schema = np.zeros((parts, entries, 1 + width), np.int64), None
        for batch in _slices(batches, parts * (width + entries)):
            n = batch.num_rows
            ids, labels = batch.column("vec_id"), batch.column("label")
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, parts, width)
            if first:
                old, bounds = None, Bounds.first(v, history[-1], unit)
            else:
                old = blob(batch.column("code"), np.uint8, n)[:, :, 0]
                bounds = Bounds(old.copy(), blob(batch.column("low"), np.uint16, n),
                                blob(batch.column("stamp"), np.uint8, n), unit)
                bounds.assign(v, history)
            total += moved(v, old, bounds.code, entries)
            nothing = pa.nulls(n, pa.binary())
            error = pa.nulls(n, pa.int64())
            if last:
                error = pa.array(sum(squared(v[:, p], history[-1][p, bounds.code[:, p]]) for p in range(parts)))
            out = pa.RecordBatch.from_arrays([
                ids, labels, pa.nulls(n, batch.column("v").type) if last else batch.column("v"),
                pa.array([c.tobytes() for c in bounds.code], pa.binary()),
                nothing if last else pa.array([b.tobytes() for b in bounds.low], pa.binary()),
                nothing if last else pa.array([b.tobytes() for b in bounds.stamp], pa.binary()),
                error, pa.nulls(n, pa.list_(pa.int64()))],
                names=["vec_id", "label", "v", "code", "low", "stamp", "error", "sums"])
            schema = out.schema
            yield out
        if schema is not None and not last:
            cells = [pa.nulls(1, f.type) for f in schema][:-1] + [pa.array([total.ravel().tolist()], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cells, schema=schema)

    return run


def codes(vectors: DataFrame, *, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
          id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """``vec_id, label, code`` (binary, a byte a part), ``error`` of every row, and the codebooks of all rounds
    (parts x entries x width integers), the last ones final."""
    if not 1 <= entries <= 256 or not 0 <= rounds < 256:
        raise ValueError("entries must be 1 to 256 and rounds below 256: codes and stamps are bytes")
    kept = written(integers(vectors, scale, id_col, vector_col, label_col), "vectors")
    ids, labels = (kept.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    schema = STATE.format(id=ids, label=labels)
    size = F.size("v")
    far = F.greatest(F.coalesce(F.array_max("v"), F.lit(0)), -F.coalesce(F.array_min("v"), F.lit(0)))
    n, shortest, longest, most = kept.agg(F.count(F.lit(1)), F.min(size), F.max(size), F.max(far)).first()
    if not n:
        empty = kept.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(0).cast("bigint").alias("error"))
        return empty, [np.zeros((parts, 0, 0), np.int64)]
    if shortest != longest or longest % parts:
        raise ValueError(f"vectors have {shortest} to {longest} components; {parts} equal parts need one length")
    if longest * (2 * (most + 1)) ** 2 >= 1 << 62:
        raise ValueError("squared distances of these components don't fit a long")
    width = longest // parts
    start = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    entries = len(start)
    history = [np.ascontiguousarray(np.array([r["v"] for r in start], np.int64).reshape(entries, parts, width).transpose(1, 0, 2))]
    # no distance exceeds 2 * most * sqrt(width): bounds in these units fit two bytes
    unit = max(1.0, 2.0 * (most + 1) * max(width, 1) ** 0.5 / 65_000)
    files, state = kept, kept
    totals = np.zeros(parts * entries * (1 + width), dtype=object)
    for k in range(rounds + 1):
        last = k == rounds
        before, files = files, written(state.mapInArrow(_round(history, unit, k == 0, last), schema), f"round-{k}")
        discard(before)
        if last:
            break
        sums = files.filter("sums is not null").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(
            F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()  # parts x entries x (1 + width) rows
        for r in sums:
            totals[r["at"]] += int(r["x"])
        history.append(_means(totals.reshape(parts, entries, 1 + width), history[-1]))
        state = files.filter("sums is null")
    return files.select("vec_id", "label", "code", "error"), history


def _means(totals: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Floored means of each entry's parts; unused entries stay. Python integers, so nothing overflows."""
    out = entries.copy()
    for p, e in np.ndindex(out.shape[:2]):
        if totals[p, e, 0]:
            out[p, e] = [s // totals[p, e, 0] for s in totals[p, e, 1:]]
    return out


def digest(vectors: DataFrame, *, label_col: str = "label", **options) -> DataFrame:
    """``vec_id, code`` (two hex digits a part), ``error, label_error, codebooks_sha256`` of every row of :func:`codes`."""
    rows, history = codes(vectors, label_col=label_col, **options)
    numbers = ",".join(str(x) for x in history[-1].ravel().tolist())
    sums = rows.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("bigint").alias("label_error"))
    return rows.join(sums, rows.label.eqNullSafe(sums["_label"])).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
        F.lit(hashlib.sha256(numbers.encode()).hexdigest()).alias("codebooks_sha256"))


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """SQL of :func:`digest`: every distance of every round, without bounds."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (SELECT r, p, CAST(m % {entries} AS BIGINT) AS e, m // {entries} AS d, part FROM
  (SELECT r, p, any_value(x.part) AS part,
          min(list_sum(list_transform(list_zip(x.part, c.part), lambda z: (z[1] - z[2])::HUGEINT * (z[1] - z[2]))) * {entries} + e) AS m
   FROM parts x JOIN c{k} c USING (p) GROUP BY r, p))""")
        if k < rounds:
            steps.append(f"""
s{k} AS (SELECT p, e, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM
  (SELECT p, e, unnest(part) AS x, generate_subscripts(part, 1) AS i FROM a{k}) GROUP BY p, e, i),
m{k} AS (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS part FROM s{k} GROUP BY p, e),
c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.part, c.part) AS part FROM c{k} c LEFT JOIN m{k} m ON c.p = m.p AND c.e = m.e)""")
    return f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
           FROM embeddings WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS part
          FROM v, (SELECT unnest(range({parts})) AS p)),
start AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM v),
c0 AS MATERIALIZED (SELECT p, e, part FROM parts JOIN start USING (r) WHERE e < {entries}),{",".join(steps)},
books AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds}),
f AS (SELECT r, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM v JOIN f USING (r), books
"""
