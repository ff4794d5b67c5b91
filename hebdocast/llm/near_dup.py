"""Near-duplicates: many universal-hash minima, banding, signature check, exact check, components.

A document's set holds its distinct runs of five words (ASCII lower case); with fewer words the whole
sequence is its one run. Documents with equal sets are one class from the start, so a group of copies
costs one signature. Each class has ``BANDS`` x ``ROWS`` minima under fixed universal hashes
(multiply, add, high bits); classes that agree on a band share a bucket. With 40 bands of 4 rows two
sets of similarity 0.75 miss each other with probability 2.5e-7.

Within buckets, pairs are not listed. First every member is held against the bucket's smallest class
only; pairs whose signatures agree well are confirmed on the full sets, and components are built. In
buckets that still hold two components, members of different components whose signatures agree are
held together as clusters. A cluster is dealt into chunks of ``CHUNK`` members (fewer where their sets are large, so a
chunk's sets stay about ``CHUNK_ITEMS`` runs), and each chunk
confirms its candidates between different components on full sets inside one task, which returns one
link a member at most. In larger clusters the members outside the largest component then meet every
chunk. So every candidate between different components is confirmed or refused on full sets.

Scale: one pass makes signatures; one shuffle of texts fetches the full sets of the classes that
have a bucket partner. Counts and minima are aggregated before shuffles and written before joins, so
the hot side of each join can be split. Nothing but counts reaches the driver.

Defined results: a document without words (or null) has an empty set and is linked with nothing; its
component is itself. Null ids are kept; a component of null ids only has a null id. Of each component
exactly one row is kept: of the rows that carry its id the one with the smallest text hash, and of rows
that repeat an id and text one. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, hashes, id_type, keyed, pick, tasks_for, worker_for, written
from .components import components
from .words import multipliers, runs, text_words

SHINGLE, BANDS, ROWS = 5, 40, 4
MARGIN = 0.19  # five and a half standard errors of a signature's estimate at 0.75
CHUNK = 512
CHUNK_ITEMS = 1 << 23  # runs of words that the sets of a chunk hold together, about


def shingle_set(h: np.ndarray, size: int, factors: np.ndarray) -> np.ndarray:
    """Distinct runs of ``size`` words, sorted; one run of all words if there are fewer."""
    return np.unique(runs(h, min(size, len(h)), factors)) if len(h) else np.empty(0, np.uint64)


def minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 1024):
        np.minimum(best, (values[None, at:at + 1024] * a[:, None] + b[:, None]).min(1), out=best)
    return (best >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signatures(rows: DataFrame, size: int, n: int, kind: str) -> DataFrame:
    """``doc_id, k1, k2, n_shingles, digest, sig``; digest and sig are null for an empty set."""

    def run(batches):
        factors, a, b = multipliers(size, "shingle"), multipliers(n, "a"), multipliers(n, "b")
        for batch in batches:
            counts, digests, sigs = [], [], []
            for *_, h in text_words(batch.column("text"), lower=True):
                values = shingle_set(h, size, factors)
                counts.append(len(values))
                digests.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None)
                sigs.append(minima(values, a, b) if len(values) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array(counts, pa.int64()),
                 pa.array(digests, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))],
                ["doc_id", "k1", "k2", "n_shingles", "digest", "sig"])

    return rows.mapInArrow(run, f"doc_id {kind}, k1 bigint, k2 bigint, n_shingles bigint, digest binary, sig array<int>")


def full_sets(rows: DataFrame, size: int, kind: str) -> DataFrame:
    """``doc_id, digest, items`` with the whole set of every row."""

    def run(batches):
        factors = multipliers(size, "shingle")
        for batch in batches:
            digests, items = [], []
            for *_, h in text_words(batch.column("text"), lower=True):
                values = shingle_set(h, size, factors)
                digests.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                items.append(values.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(digests, pa.binary()),
                 pa.array(items, pa.list_(pa.int64()))], ["doc_id", "digest", "items"])

    return rows.mapInArrow(run, f"doc_id {kind}, digest binary, items array<bigint>")


def agreement(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs ``u < v`` whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("v"), F.col("items").alias("iv"))
    right = sets.select(F.col("node").alias("u"), F.col("items").alias("iu"))
    both = pairs.join(left.hint("merge"), "v").join(right.hint("merge"), "u")
    common = F.size(F.array_intersect("iu", "iv"))
    return both.select("u", "v", common.alias("c"), (F.size("iu") + F.size("iv")).alias("t")).filter(
        100 * F.col("c") >= percent * (F.col("t") - F.col("c"))).select("u", "v")


class Sets:
    """Disjoint sets of node numbers."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _ordered(table, *keys: str) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Columns, row order and group bounds of an Arrow table sorted by ``keys``."""
    cols = [table.column(k).to_numpy() for k in keys]
    order = np.lexsort(cols[::-1])
    cols = [c[order] for c in cols]
    change = np.zeros(max(len(order) - 1, 0), bool)
    for c in cols[:-1]:
        change |= c[1:] != c[:-1]
    return cols, order, np.concatenate([[0], np.flatnonzero(change) + 1, [len(order)]])


def _matrix(table, name: str, order: np.ndarray) -> np.ndarray:
    return np.asarray(table.column(name).combine_chunks().flatten()).reshape(len(order), -1)[order]


def _edges(us: list[int], vs: list[int]) -> pa.Table:
    return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})


def open_groups(members: DataFrame, least: int) -> DataFrame:
    """Links ``u, v`` that hold together the members of a bucket that lie in different components
    and whose signatures agree in ``least`` places, at most one a member. ``members``: ``cell`` (a
    bounded set of buckets), ``key, node, root, sig``."""

    def run(table):
        worker_for("words")
        (key, node), order, bounds = _ordered(table, "key", "node")
        root, sig = table.column("root").to_numpy()[order], _matrix(table, "sig", order)
        us, vs = [], []
        for s, e in zip(bounds[:-1], bounds[1:]):
            sets = Sets()
            for i in range(s + 1, e):
                other = np.flatnonzero(root[s:i] != root[i])
                if len(other):
                    for j in other[(sig[s + other] == sig[i]).sum(1) >= least].tolist():
                        if sets.join(int(node[s + j]), int(node[i])):
                            us.append(int(node[s + j]))
                            vs.append(int(node[i]))
        return _edges(us, vs)

    return members.groupBy("cell").applyInArrow(run, "u bigint, v bigint").distinct()


def common_items(items: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Size of the intersection of ``items[i]`` and ``items[j]`` for every ``i, j`` of the lists."""
    if len(left) < 8 * len(items):
        return np.array([len(np.intersect1d(items[i], items[j], assume_unique=True))
                         for i, j in zip(left.tolist(), right.tolist())], np.int64)
    flat = np.concatenate(items)
    row = np.repeat(np.arange(len(items)), [len(x) for x in items])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    first = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1
    column, row = np.unique(column[shared], return_inverse=True)[1], row[shared]
    total = np.zeros((len(items), len(items)))
    step = 4096  # columns of the incidence matrix held at once
    for at in range(0, int(column.max(initial=-1)) + 1, step):
        lo, hi = np.searchsorted(column, [at, at + step])
        part = np.zeros((len(items), step), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        total += part @ part.T
    return total[left, right].astype(np.int64)


def linked(members: DataFrame, least: int, percent: int) -> DataFrame:
    """Links between members of one block, confirmed on full sets, at most one a member: a pair that
    earlier links already connect needs none. ``members``: ``cell`` (a bounded set of blocks),
    ``block, node, root, hub, sig, items``; of two members one must be a hub."""

    def run(table):
        worker_for("words")
        (block, node), order, bounds = _ordered(table, "block", "node")
        root, sig = table.column("root").to_numpy()[order], _matrix(table, "sig", order)
        hub = np.array(table.column("hub").to_pylist(), bool)[order]
        items = table.column("items").combine_chunks()
        lists = items.flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(items.value_lengths().to_numpy())])
        us, vs = [], []
        for s, e in zip(bounds[:-1], bounds[1:]):
            left, right, same = [], [], []
            for i in range(s + 1, e):
                other = np.flatnonzero((root[s:i] != root[i]) & (hub[s:i] | hub[i]) & (node[s:i] != node[i]))
                if len(other):
                    agree = (sig[s + other] == sig[i]).sum(1)
                    other, agree = other[agree >= least], agree[agree >= least]
                    left.append(other)
                    right.append(np.full(len(other), i - s))
                    same.append(agree)
            if not left:
                continue
            left, right, same = map(np.concatenate, (left, right, same))
            best = np.argsort(-same, kind="stable")
            left, right = left[best], right[best]
            own = [lists[ends[k]:ends[k + 1]] for k in order[s:e].tolist()]
            size = np.array([len(x) for x in own])
            common = common_items(own, left, right)
            good = 100 * common >= percent * (size[left] + size[right] - common)
            sets = Sets()
            for i, j in zip((left[good] + s).tolist(), (right[good] + s).tolist()):
                if sets.join(int(root[i]), int(root[j])):
                    us.append(int(node[i]))
                    vs.append(int(node[j]))
        return _edges(us, vs)

    return members.groupBy("cell").applyInArrow(run, "u bigint, v bigint").distinct()


def searched(seeds: DataFrame, links: DataFrame, found: DataFrame, nodes: DataFrame, weights: DataFrame, least: int,
             percent: int, chunk: int, chunk_items: int) -> DataFrame:
    """``links`` and those that it misses between nodes that ``seeds`` hold together. Such a cluster is
    dealt into chunks that are searched each for itself; then the nodes outside a cluster's largest
    component, the hubs, are held against all of its chunks. ``weights`` (``node, weight``) are set sizes: chunks
    and tasks follow both the members and what their sets hold."""

    tasks = tasks_for(seeds.count())

    def placed(found, parts):
        return written(clusters.join(parts.hint("merge"), "cluster").join(found.hint("merge"), "node", "left")
                       .withColumn("root", F.coalesce("root", "node")), "placed", tasks)

    def weighed(rows):
        return rows.join(weights.hint("merge"), "node", "left")

    def shares():
        return F.greatest(F.ceil(F.count(F.lit(1)) / chunk), F.ceil(F.coalesce(F.sum("weight"), F.lit(0)) / chunk_items))

    def of_blocks(rows):
        n, weight = weighed(rows.select("node")).agg(F.count(F.lit(1)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        cells = max(1, n // 1000, weight // chunk_items)
        dealt = rows.withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(cells)))
        return linked(dealt.join(nodes.hint("merge"), "node"), least, percent).coalesce(max(12, cells))

    clusters = written(components(seeds).withColumnRenamed("root", "cluster").distinct(), "clusters", tasks)
    parts = written(weighed(clusters).groupBy("cluster").agg(shares().alias("parts")), "parts", tasks)
    at = F.pmod(F.xxhash64("node"), F.col("parts"))
    now = placed(found, parts)
    own = now.select(F.xxhash64("cluster", at).alias("block"), "node", "root", F.lit(True).alias("hub"))
    links = written(links.union(of_blocks(own)), "links")
    discard(now)
    large = written(parts.filter("parts > 1"), "large", tasks)
    if large.isEmpty():
        discard(clusters, parts, large)
        return links
    joined = written(components(links), "components")
    now = placed(joined, large)
    discard(clusters, parts, large, joined)
    sizes = now.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("size"))
    most = written(sizes.groupBy("cluster").agg(F.max_by("root", F.struct("size", "root")).alias("main")), "most", tasks)
    hubs = written(now.join(most.hint("merge"), "cluster").filter("root <> main").drop("main"), "hubs", tasks)
    turns = written(weighed(hubs).groupBy("cluster").agg(shares().alias("turns")), "turns", tasks)
    block = F.xxhash64("cluster", "at", "turn").alias("block")
    range_of = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    members = now.join(turns.hint("merge"), "cluster").withColumn("at", at).withColumn("turn", range_of("turns"))
    guests = hubs.join(turns.hint("merge"), "cluster").withColumn(
        "turn", F.pmod(F.xxhash64("node", F.lit(1)), F.col("turns"))).withColumn("at", range_of("parts"))
    both = members.select(block, "node", "root", F.lit(False).alias("hub")).union(
        guests.select(block, "node", "root", F.lit(True).alias("hub")))
    both = written(both, "blocks", tasks)
    out = written(links.union(of_blocks(both)), "links")
    discard(now, most, hubs, turns, both, links)
    return out


def decided(docs: DataFrame, *, percent: int = 75, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS,
            chunk: int = CHUNK, chunk_items: int = CHUNK_ITEMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, k1, k2, n_shingles, component_id, kept`` of every row; ``k1, k2`` hash its id and text. Tables that the result
    doesn't read are deleted."""
    kind, n = id_type(docs, id_col), bands * rows
    least = int(np.floor((percent / 100 - MARGIN) * n))
    texts = pick(docs, id_col, text_col)
    signed = written(signatures(keyed(docs, id_col, text_col), size, n, kind)
                     .withColumn("row", F.monotonically_increasing_id()), "signed")
    # One class for every distinct set. Equal sets have equal signatures.
    classes = written(signed.filter("digest is not null").groupBy("digest").agg(
        F.min("row").alias("node"), F.first("sig").alias("sig"),
        # the smallest id, nulls last; then the smallest hashes, then the first row
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2", "row")).alias("least"),
        F.min_by("doc_id", "row").alias("doc_id")), "classes")

    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)),
                       lambda k: F.xxhash64(k, F.slice("sig", k * rows + 1, F.lit(rows))))
    banded = classes.select("node", F.explode(keys).alias("key"))
    buckets = written(banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub"))
                      .filter("n > 1"), "buckets")
    members = written(banded.join(buckets.hint("merge"), "key"), "members")

    # The sets of all classes that share a bucket: the one shuffle of texts.
    wanted = members.select("node").distinct().join(classes.hint("merge"), "node").select("doc_id", "digest", "node")
    wanted = written(wanted, "wanted")
    asked = wanted.select(F.col("doc_id").alias("asked")).distinct()
    some = texts.join(asked.hint("shuffle_hash"), texts.doc_id.eqNullSafe(F.col("asked")), "left_semi")
    made = full_sets(some, size, kind).dropDuplicates(["doc_id", "digest"])
    sets = written(wanted.join(made.withColumnRenamed("doc_id", "set_id").hint("merge"), [
        wanted.digest == made.digest, wanted.doc_id.eqNullSafe(F.col("set_id"))]).select("node", "items"), "sets")

    sig = classes.select("node", "sig")
    stars = members.filter("hub <> node").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
    stars = (stars.join(sig.select(F.col("node").alias("v"), F.col("sig").alias("sv")).hint("merge"), "v")
             .join(sig.select(F.col("node").alias("u"), F.col("sig").alias("su")).hint("merge"), "u")
             .filter(agreement(F.col("su"), F.col("sv")) >= least).select("u", "v"))
    links = written(confirmed(stars, sets, percent), "links")
    found = written(components(links), "components")

    # Buckets that still hold two components.
    tasks = tasks_for(members.count(), 200_000)
    rooted = written(members.select("key", "node", "n", "hub").join(found.hint("merge"), "node", "left").withColumn(
        "root", F.coalesce("root", "node")), "rooted", tasks)
    split = written(rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
                    .filter("low <> high").select("key"), "split", tasks)
    todo = written(rooted.join(split.hint("merge"), "key", "left_semi"), "todo", tasks)
    discard(rooted, split)
    discard(buckets, members)
    n_rows = todo.count()
    if n_rows:
        cells = max(1, n_rows // 5_000)
        cell = F.pmod(F.xxhash64("key"), F.lit(cells))
        small = todo.filter(F.col("n") <= chunk).select("key", "node", "root", cell.alias("cell"))
        seeds = open_groups(small.join(sig.hint("merge"), "node"), least).union(
            todo.filter((F.col("n") > chunk) & (F.col("hub") != F.col("node")))
            .select(F.col("hub").alias("u"), F.col("node").alias("v")))
        seeds = written(seeds, "seeds", max(12, cells))
        first = links, found
        links = searched(seeds, links, found, sig.join(sets.hint("merge"), "node"),
                         sets.select("node", F.size("items").cast("bigint").alias("weight")), least, percent, chunk, chunk_items)
        found = written(components(links), "components")
        discard(seeds, first[1])

    rooted = classes.join(found.hint("merge"), "node", "left").select(
        "digest", "least", F.coalesce("root", "node").alias("root"))
    rooted = written(rooted, "rooted")
    discard(classes, wanted, sets, todo, links, found)
    smallest = rooted.groupBy("root").agg(F.min("least").alias("least"))
    smallest = written(smallest.select("root", F.col("least.doc_id").alias("component_id"),
                                       F.col("least.row").alias("chosen")), "smallest")
    named = written(rooted.join(smallest.hint("merge"), "root").select("digest", "component_id", "chosen"), "named")
    discard(rooted, smallest)
    out = signed.select("row", "doc_id", "k1", "k2", "n_shingles", "digest").join(named.hint("merge"), "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "k1", "k2", "n_shingles", component.alias("component_id"),
                      (F.col("digest").isNull() | (F.col("row") == F.col("chosen"))).alias("kept"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row. Two documents are linked when
    100 x intersection >= ``percent`` x union of their sets; ``component_id`` is the smallest id that
    links reach, and ``kept`` marks the one row of each component that stays. Options as in
    :func:`decided`."""
    return decided(docs, **options).select("doc_id", "n_shingles", "component_id", "kept")


def without_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with all columns; of each component only the row that is kept."""
    rows = decided(docs, id_col=id_col, text_col=text_col, **options)
    # Rows that repeat an id and text have one key: of those that stay, one is taken below.
    keys = written(rows.groupBy("k1", "k2").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"),
                                                F.max(F.col("n_shingles") > 0).alias("worded"))
                   .filter("not kept or worded and n > 1"), "keys")
    at = docs.withColumns(dict(zip(("_k1", "_k2"), hashes(id_col, text_col))))
    keys = keys.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "kept")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = at.join(keys.hint("shuffle_hash"), ["_k1", "_k2"], "left_anti").select(*columns)
    twice = keys.filter("kept").drop("kept")
    if twice.isEmpty():
        return out
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    one = at.join(twice, ["_k1", "_k2"]).groupBy("_k1", "_k2").agg(
        F.min_by(F.struct(*columns), F.struct(F.xxhash64(*hashed), F.xxhash64(F.lit(1), *hashed))).alias("_row"))
    return out.union(one.select("_row.*"))
