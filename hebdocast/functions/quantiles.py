"""Exact quantiles without gathering a column into one task.

``percentile`` keeps a value->count map per group, which for a continuous
column over the whole table is one unbounded buffer. Here the values are
range-partitioned and sorted by the cluster; each row's global rank is its
position inside its partition plus the sizes of the partitions before it (a
table with one row per partition and column). Only the rows at the wanted
ranks are kept, and linear interpolation (the pandas/numpy rule) is applied.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row index in the low 33 bits


def stack_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long (column, value) rows, non-null values only, cast to double."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
        for c in columns
    ])
    return (df.select(F.explode(pairs).alias("kv")).select("kv.column", "kv.value")
            .where(F.col("value").isNotNull()))


def _offsets(blocks: DataFrame, part: str) -> DataFrame:
    """``blocks`` (a row per partition and key, with ``n_block``) with the rows of the key before each and the key's ``n``."""
    before = Window.partitionBy("k").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return (blocks.withColumn("offset", F.coalesce(F.sum("n_block").over(before), F.lit(0)))
            .withColumn("n", F.sum("n_block").over(Window.partitionBy("k"))))


def rank_within_key(long_df: DataFrame, key: str = "k", value: str = "v",
                    partitions: int | None = None) -> DataFrame:
    """Rows of a (key, value) frame with their 0-based rank by value within key.

    Range partitioning sorts across the cluster; a row's rank is its index in
    its partition plus the sizes of earlier partitions holding the same key
    (a table of at most partitions x keys rows, joined by partition and key). No task sees
    more than its range partition, whatever the key distribution. The sorted rows are a
    table in the shared folder, so both readings see the same ranges.
    """
    spark = long_df.sparkSession
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (long_df.select(F.col(key).alias("k"), F.col(value).alias("v"))
              .repartitionByRange(n_parts, "k", "v")
              .sortWithinPartitions("k", "v")
              .withColumn("_mid", F.monotonically_increasing_id())
              .select("k", "v", F.shiftright("_mid", _LOCAL_BITS).alias("_pid"),
                      F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)).alias("_local")))
    rows = stored(placed, "ranks")
    blocks = _offsets(rows.groupBy("_pid", "k").agg(F.count(F.lit(1)).alias("n_block"), F.min("_local").alias("first_local")),
                      "_pid")
    return (rows.join(blocks.select("_pid", "k", "offset", "first_local"), ["_pid", "k"])
            .select(F.col("k").alias(key), F.col("v").alias(value),
                    (F.col("offset") + F.col("_local") - F.col("first_local")).alias("rank")))


_CUM_SCHEMA = "k string, v double, w long, pid int, cum long"


def _running_weights(batches):
    """Per partition (already sorted by k, v): running weight per key."""
    import pandas as pd
    from pyspark import TaskContext
    pid = TaskContext.get().partitionId()
    carry_k, carry = None, 0
    for pdf in batches:
        if pdf.empty:
            continue
        k = pdf["k"].to_numpy()
        w = pdf["w"].to_numpy(dtype="int64")
        new_key = pd.Series(k).ne(pd.Series(k).shift()).to_numpy()
        new_key[0] = k[0] != carry_k
        grp = new_key.cumsum()
        cum = pd.Series(w).groupby(grp).cumsum().to_numpy()
        if not new_key[0]:
            cum[grp == grp[0]] += carry
        carry_k, carry = k[-1], int(cum[-1])
        yield pd.DataFrame({"k": k, "v": pdf["v"].to_numpy(dtype="float64"), "w": w,
                            "pid": pid, "cum": cum})


def exact_quantiles(long_df: DataFrame, probs: Sequence[float],
                    key: str = "column", value: str = "value",
                    partitions: int | None = None) -> DataFrame:
    """(key, prob, quantile) for every key of a long (key, value) frame, with
    linear interpolation between the ranks floor/ceil(q * (n - 1)).

    Values are first counted per distinct (key, value) — a map-side combined
    aggregate, so repeated values never travel twice — then the distinct
    values are range-partitioned and sorted; each partition computes running
    counts per key and the per-(partition, key) totals (a bounded table)
    give every value its global rank interval.
    """
    spark = long_df.sparkSession
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    hist = (long_df.select(F.col(key).cast("string").alias("k"), F.col(value).cast("double").alias("v"))
            .groupBy("k", "v").agg(F.count(F.lit(1)).alias("w")))
    cum = stored(hist.repartitionByRange(n_parts, "k", "v").sortWithinPartitions("k", "v")
                 .mapInPandas(_running_weights, _CUM_SCHEMA), "quantiles")
    blocks = _offsets(cum.groupBy("pid", "k").agg(F.sum("w").alias("n_block")), "pid")
    prob_arr = F.array(*[F.lit(float(p)) for p in probs])
    targets = (blocks.select("k", "n").distinct()
               .select("k", "n", F.explode(prob_arr).alias("prob"))
               .withColumn("h", F.col("prob") * (F.col("n") - 1))
               .withColumn("lo", F.floor("h").cast("long"))
               .withColumn("hi", F.ceil("h").cast("long")))
    wanted = targets.select("k", "prob", "h", "lo", "hi", F.explode(F.array("lo", "hi")).alias("r"))
    # the partition that holds each wanted rank, so that rows meet only the ranks of their own partition
    located = (wanted.join(blocks.select("pid", "k", "offset", "n_block"), "k")
               .where((F.col("r") >= F.col("offset")) & (F.col("r") < F.col("offset") + F.col("n_block"))))
    # rank interval of a distinct value: [offset + cum - w, offset + cum)
    end = F.col("offset") + F.col("cum")
    hit = (cum.join(located, ["pid", "k"]).where((F.col("r") >= end - F.col("w")) & (F.col("r") < end))
           .select("k", "prob", "h", "lo", "hi", "r", "v"))
    return (hit.groupBy("k", "prob")
            .agg(F.max(F.when(F.col("r") == F.col("lo"), F.col("v"))).alias("v_lo"),
                 F.max(F.when(F.col("r") == F.col("hi"), F.col("v"))).alias("v_hi"),
                 F.first("h").alias("h"), F.first("lo").alias("lo"))
            .select(F.col("k").alias(key), "prob",
                    (F.col("v_lo") + (F.col("h") - F.col("lo")) * (F.col("v_hi") - F.col("v_lo")))
                    .alias("quantile")))


# --- quantiles of wide tables, by bracketing --------------------------------------------------
FEW = 50_000  # values of a bracket that the driver may hold


def bracketed_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], accuracy: int = 2_000,
                        few: int = FEW) -> dict[str, list[float]]:
    """Exact quantiles (linear interpolation) of many columns; null and NaN don't count, columns without values are left out.

    One wide aggregate of mergeable sketches gives values just below and just above each wanted rank. A pass then counts
    the rows below, at and between them, which places the rank exactly: at one of those values, or in an open
    interval of about n/accuracy rows. Intervals of more than ``few`` rows are bracketed again inside;
    the values of the others are collected. Nothing is exploded, sorted or shuffled but those.
    """
    import numpy as np
    x = df.select(*[F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")).alias(f"x{i}")
                    for i, c in enumerate(columns)])
    counts = x.agg(*[F.count(f"x{i}").alias(f"x{i}") for i in range(len(columns))]).first()
    # a target: column, 0-based rank, open interval that holds it, rows up to its lower end, rows inside
    ranks = {}
    for i in range(len(columns)):
        for p in probs if counts[i] else ():
            h = p * (counts[i] - 1)
            ranks[i, p] = (int(np.floor(h)), int(np.ceil(h)), h)
    targets = {(i, r): (-np.inf, np.inf, 0, counts[i]) for (i, _), (lo, hi, _) in ranks.items() for r in (lo, hi)}
    values: dict[tuple[int, int], float] = {}
    while targets:
        small = {k: t for k, t in targets.items() if t[3] <= few}
        if small:
            inside = _values_inside(x, {(i, lo, hi) for (i, _), (lo, hi, _, _) in small.items()})
            for (i, r), (lo, hi, below, _) in small.items():
                v, n = inside[i, lo, hi]
                values[i, r] = float(v[np.searchsorted(np.cumsum(n), r - below, side="right")])
                del targets[i, r]
            continue
        points = _sketched(x, targets, accuracy)
        found = _cell_counts(x, points)
        for (i, r), (lo, hi, below, inside) in list(targets.items()):
            p, n = points[i], found[i]
            # cells: open interval before point 0, point 0, open interval after it, ...
            cell = int(np.searchsorted(np.cumsum(n), r, side="right"))
            if cell % 2:
                values[i, r] = float(p[cell // 2])
                del targets[i, r]
            else:
                at = cell // 2
                targets[i, r] = (p[at - 1] if at else -np.inf, p[at] if at < len(p) else np.inf, int(n[:cell].sum()), int(n[cell]))
    out: dict[str, list[float]] = {}
    for (i, p), (lo, hi, h) in ranks.items():
        out.setdefault(columns[i], []).append(values[i, lo] + (h - lo) * (values[i, hi] - values[i, lo]))
    return out


def _sketched(x: DataFrame, targets: dict, accuracy: int) -> dict:
    """Sorted values near the wanted ranks of each column, from one aggregate of sketches."""
    import numpy as np
    wanted: dict[tuple[int, float, float], set[float]] = {}
    for (i, r), (lo, hi, below, inside) in targets.items():
        at, room = (r - below + 0.5) / inside, 1.5 / accuracy
        wanted.setdefault((i, lo, hi), set()).update((max(0.0, at - room), min(1.0, at + room)))
    aggs = []
    for k, ((i, lo, hi), shares) in enumerate(wanted.items()):
        v = F.col(f"x{i}")
        v = v if lo == -np.inf and hi == np.inf else F.when((v > F.lit(float(lo))) & (v < F.lit(float(hi))), v)
        aggs.append(F.percentile_approx(v, F.array(*[F.lit(float(s)) for s in sorted(shares)]), accuracy).alias(f"p{k}"))
    row = x.agg(*aggs).first()
    points: dict[int, set] = {}
    for k, (i, lo, hi) in enumerate(wanted):
        points.setdefault(i, set()).update(row[k])
    for (i, _), (lo, hi, _, _) in targets.items():  # the intervals' own ends stay points
        points[i].update(e for e in (lo, hi) if np.isfinite(e))
    return {i: np.array(sorted(v)) for i, v in points.items()}


def _cell_counts(x: DataFrame, points: dict) -> dict:
    """Rows of each column in the cells of its points: before the first, at it, between it and the next, and so on."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        total = {i: np.zeros(2 * len(p) + 1, np.int64) for i, p in points.items()}
        for batch in batches:
            for i, p in points.items():
                v = batch.column(f"x{i}").drop_null().to_numpy(zero_copy_only=False)
                cell = np.searchsorted(p, v, side="left") + np.searchsorted(p, v, side="right")
                total[i] += np.bincount(cell, minlength=2 * len(p) + 1)
        for i, n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), i, np.int32)), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)],
                                             names=["i", "cell", "n"])

    out = {i: np.zeros(2 * len(p) + 1, np.int64) for i, p in points.items()}
    for r in x.mapInArrow(run, "i int, cell int, n bigint").groupBy("i", "cell").agg(F.sum("n").alias("n")).collect():
        out[r["i"]][r["cell"]] = r["n"]
    return out


def _values_inside(x: DataFrame, intervals: set) -> dict:
    """Distinct values with their counts, ascending, of open intervals (column, low, high) that hold few rows."""
    import numpy as np
    import pyarrow as pa
    order = sorted(intervals)

    def run(batches):
        for batch in batches:
            for k, (i, lo, hi) in enumerate(order):
                v = batch.column(f"x{i}").drop_null().to_numpy(zero_copy_only=False)
                v, n = np.unique(v[(v > lo) & (v < hi)], return_counts=True)
                if len(v):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(v), pa.array(n)], names=["k", "v", "n"])

    rows = x.mapInArrow(run, "k int, v double, n bigint").groupBy("k", "v").agg(F.sum("n").alias("n")).collect()
    out = {}
    for k, key in enumerate(order):
        mine = sorted((r["v"], r["n"]) for r in rows if r["k"] == k)
        out[key] = np.array([v for v, _ in mine]), np.array([n for _, n in mine], np.int64)
    return out
