"""Secret scan with a random forest against false positives.

Patterns propose candidates: long runs of key-like characters, and values assigned to a name that
speaks of a secret. A random forest decides on each: features are the candidate's length, character
classes and transitions, the share of it that dictionary words cover, its path and the words and
signs around it. The dictionary holds the most frequent words of all documents; the forest is trained
with MLlib from labelled findings. A table of such findings may be given; without one, findings with
known labels are written into the words of a bounded sample of documents: keys of public formats in
the places where keys stand, and look-alikes (digests, commits, UUIDs, addresses, numbers,
identifiers, placeholders, words written together, code) in theirs. A value runs to its delimiter (white
space, quote, comma or semicolon), however long it is.

Scale: the dictionary is one aggregate, merged in the tasks first and stored, so that tasks hand on its most frequent words only; its ``WORDS`` entries of at most 12
letters and the forest's nodes are all that the tasks are handed. Scanning and redacting are one pass
each, without a shuffle.

Defined results: a null text has no findings and stays null; null ids and paths are kept; overlapping
candidates count once, the longer first; repeated rows give their findings each; an empty table gives
no rows (and needs a given table of findings for a useful forest: without examples nothing is found).
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_type, most_frequent, worker_for, written

WORDS = 20_000
SAMPLE = 1_500  # documents whose words surround the examples
# Names that speak of a secret, and names of public digests and ids.
SECRET_NAMES = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key",
                "auth", "bearer", "credential", "private_key", "client_secret")
PUBLIC_NAMES = ("sha", "sha1", "sha256", "md5", "commit", "checksum", "digest", "hash", "etag", "revision", "uuid",
                "id", "version", "isbn", "build")
PLACEHOLDERS = ("example", "changeme", "your_", "xxxx", "dummy", "sample", "placeholder", "test", "${", "<", "****")
RUN = re.compile(rb"[A-Za-z0-9+/_\-]{16,}(?:\.[A-Za-z0-9+/_\-]{16,})*={0,2}")
VALUE = re.compile(rb"(?:%s)[\w\-]{0,20}[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?([^\s\"',;]{8,})" %
                   b"|".join(re.escape(n.encode()) for n in SECRET_NAMES), re.I)


def dictionary(docs: DataFrame, text_col: str, size: int = WORDS) -> list[str]:
    """The most frequent words of three to twelve letters, of any script, in all documents."""

    def gather(batches):
        worker_for("secrets")
        found: Counter = Counter()
        for batch in batches:
            words: Counter = Counter()
            for text in batch.column("text"):
                words.update((text.as_py() or b"").split())
                if len(words) > 200_000:
                    _fold(words, found)
                    words = Counter()
            _fold(words, found)
            if len(found) > 300_000:
                yield _rows(found)
                found = Counter()
        if found:
            yield _rows(found)

    def _fold(words, found):
        for word, n in words.items():
            if 3 <= len(word) <= 48:  # at most four bytes a letter
                letters = word.decode("utf-8", "ignore").lower()
                if letters.isalpha() and 3 <= len(letters) <= 12:
                    found[letters] += n

    def _rows(found):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    texts = docs.select(F.col(f"`{text_col}`").cast("binary").alias("text"))
    counts = written(texts.mapInArrow(gather, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    top = most_frequent(counts, "word", "n", size).collect()  # at most ``size`` short words
    discard(counts)
    return [r["word"] for r in top]


def candidates(text: bytes) -> list[tuple[int, int]]:
    """Byte spans that may hold a secret, in order, without overlaps."""
    spans = [m.span() for m in RUN.finditer(text)]
    spans += [m.span(1) for m in VALUE.finditer(text)]
    spans.sort(key=lambda s: (s[0] - s[1], s[0]))
    kept: list[tuple[int, int]] = []
    if len(spans) < 2:
        return spans
    taken = sorted(spans)
    best = {s: i for i, s in enumerate(spans)}  # longer first
    for span in taken:
        if kept and span[0] < kept[-1][1]:
            if best[span] < best[kept[-1]]:
                kept[-1] = span
        else:
            kept.append(span)
    return kept


def coverage(text: str, words: set[str]) -> float:
    """Share of the characters that a greedy cover by dictionary words reaches."""
    text, at, hit = text.lower(), 0, 0
    while at < len(text):
        size = next((k for k in range(min(12, len(text) - at), 2, -1) if text[at:at + k] in words), 0)
        hit += size
        at += size or 1
    return hit / max(1, len(text))


def features(text: bytes, start: int, end: int, path: str | None, words: set[str]) -> list[float]:
    value = text[start:end].decode("utf-8", "replace")
    before = text[max(0, start - 48):start].decode("utf-8", "replace").lower()
    after = text[end:end + 24].decode("utf-8", "replace").lower()
    kinds = ["d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "s" for c in value]
    n, freq = len(value), Counter(value)
    names = re.findall(r"[\w\-]+", before)[-3:]
    path = (path or "").lower()
    share = [kinds.count(k) / n for k in "dlus"]
    return [
        float(n), *share, sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        -sum(c / n * math.log2(c / n) for c in freq.values()), len(freq) / n,
        float(set(value) <= set("0123456789abcdefABCDEF")), coverage(value, words),
        float(any(p in value.lower() for p in PLACEHOLDERS)),
        float(any(s in x for x in names for s in SECRET_NAMES)),
        float(any(x == p for x in names for p in PUBLIC_NAMES)),
        float(bool(re.search(r"[:=]\s*[\"']?$", before))), float(before[-1:] in "\"'" and before != ""),
        float(after[:1] in "\"'" and after != ""), float("@" in after[:2] or before.endswith("@")),
        float(before.endswith("/") or "://" in before[-12:]),
        sum(x in words for x in re.findall(r"[^\W\d_]+", before + " " + after)) / 8,
        float(any(p in path for p in ("test", "example", "doc", "lock"))),
        float(any(p in path for p in (".env", "conf", ".yml", ".json", "secret"))), float(path.count("/")),
    ]


def examples(text: str, seed: int) -> list[tuple[str, int, int, float]]:
    """Findings with known labels among the words of a text: ``(context, start, end, label)``."""
    rnd = random.Random(seed)
    words = re.findall(r"[^\W\d_]+", text) or ["word"]
    some = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    letters = "abcdefghijklmnopqrstuvwxyz"
    alnum = letters + letters.upper() + "0123456789"
    pick = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
    hexes = lambda: pick("0123456789abcdef", rnd.choice((32, 40, 40, 48, 64)))
    keys = (hexes, hexes, lambda: pick(alnum, rnd.randint(20, 64)), lambda: pick(alnum + "+/", 40) + "=",
            lambda: "AKIA" + pick(alnum[26:], 16), lambda: "ghp_" + pick(alnum, 36),
            lambda: "sk_live_" + pick(alnum, 24), lambda: pick(alnum + "!#%^&*", rnd.randint(9, 18)),
            lambda: f"eyJ{pick(alnum, 20)}.eyJ{pick(alnum, 40)}.{pick(alnum + '_-', 43)}")
    public = (hexes, lambda: f"{pick('0123456789abcdef', 8)}-" + "-".join(pick("0123456789abcdef", 4) for _ in range(3))
              + f"-{pick('0123456789abcdef', 12)}")
    name = rnd.choice(SECRET_NAMES)
    name = rnd.choice((name, name.upper(), rnd.choice(words) + "_" + name))
    sign, quote = rnd.choice((" = ", "=", ": ", " : ")), rnd.choice(('"', '"', "'", ""))
    joined = lambda: rnd.choice("_-/").join(rnd.choice(words).lower() for _ in range(rnd.randint(3, 6)))
    rows = [(f"{some(6)} {name}{sign}{quote}", rnd.choice(keys)(), f"{quote} {some(5)}", 1.0) for _ in range(3)]
    rows += [
        (f"{some(6)} {rnd.choice(PUBLIC_NAMES)}{rnd.choice((' ', ': ', '=', ' = '))}{quote}", rnd.choice(public)(), f"{quote} {some(5)}", 0.0),
        (f"{some(8)} ", hexes(), f" {some(5)}", 0.0),
        (f"{some(6)} {name}{sign}{quote}", rnd.choice(("changeme", "your_token_here", "example-value", "xxxxxxxxxxxx",
                                                     "${" + name.upper() + "}", "<" + some(1) + "-here>")), f"{quote} {some(4)}", 0.0),
        (f"{some(7)} ", joined() + rnd.choice(("", str(rnd.randint(1, 2030)))), f" {some(5)}", 0.0),
        (f"{some(6)} {name}{sign}{quote}", joined(), f"{quote} {some(5)}", 0.0),
        (f"{some(7)} ", pick("0123456789", rnd.choice((16, 16, 18, 20))), f" {some(5)}", 0.0),
        (f"{some(6)} ", rnd.choice(words).lower() + pick("0123456789", 14), f"@{some(1)}.example.com {some(3)}", 0.0),
        (f"{some(4)} https://{rnd.choice(words).lower()}.example.com/", joined() + pick("0123456789", 4), f" {some(4)}", 0.0),
    ]
    # long values of names, and runs of letters only: keys, and words written together
    case = letters + letters.upper()
    word = lambda: rnd.choice(words)
    glued = lambda: "".join(word().lower() for _ in range(rnd.randint(3, 8)))
    camel = lambda: "".join(word().capitalize() for _ in range(rnd.randint(3, 8)))
    long = lambda: "".join(rnd.choice(("%2B", "%2F", "%3D", "&", "~", "")) + pick(alnum, rnd.randint(4, 24))
                           for _ in range(rnd.randint(12, 60)))
    code = lambda: "".join(word() + rnd.choice(("(", ").", "[", "].", "&&", "=", "=>{", "}")) for _ in range(rnd.randint(3, 60)))
    rows += [
        (f"{some(6)} {name}{sign}{quote}", long(), f"{quote} {some(5)}", 1.0),
        (f"{some(6)} {name}{sign}{quote}", pick(case, rnd.randint(20, 64)), f"{quote} {some(5)}", 1.0),
        (f"{some(8)} ", pick(rnd.choice((case, letters, letters.upper())), rnd.randint(24, 64)), f" {some(5)}", 1.0),
        (f"{some(8)} ", rnd.choice((glued, camel))(), f" {some(5)}", 0.0),
        (f"{some(8)} ", rnd.choice((word().lower(), word())) * rnd.randint(2, 12), f" {some(5)}", 0.0),
        (f"{some(8)} ", rnd.choice(case) * rnd.randint(16, 400), f" {some(5)}", 0.0),
        (f"{some(6)} {name}{sign}", rnd.choice((glued, camel, code))(), f" {some(5)}", 0.0),
    ]
    return [(a + v + b, len((a).encode()), len((a + v).encode()), y) for a, v, b, y in rows if len(v.encode()) >= 8]


class Forest:
    """Nodes of a fitted random forest as arrays, for use inside tasks."""

    def __init__(self, model):
        self.trees = []
        for tree in model.trees:
            feature, cut, low, high, value = [], [], [], [], []

            def add(node):
                at = len(feature)
                inner = node.numDescendants() > 0
                stats = list(node.impurityStats().stats())
                feature.append(node.split().featureIndex() if inner else -1)
                cut.append(node.split().threshold() if inner else 0.0)
                value.append(stats[1] / max(1e-9, sum(stats)))
                low.append(0)
                high.append(0)
                if inner:
                    low[at], high[at] = add(node.leftChild()), add(node.rightChild())
                return at

            add(tree._call_java("rootNode"))
            self.trees.append(tuple(map(np.array, (feature, cut, low, high, value))))

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for feature, cut, low, high, value in self.trees:
            at = np.zeros(len(rows), np.int64)
            while (inner := np.flatnonzero(feature[at] >= 0)).size:
                here = at[inner]
                left = rows[inner, feature[here]] <= cut[here]
                at[inner] = np.where(left, low[here], high[here])
            total += value[at]
        return total / max(1, len(self.trees))


def labelled(docs: DataFrame, *, sample: int, id_col: str, text_col: str, path_col: str | None) -> DataFrame:
    """Examples in the words of the ``sample`` documents with the smallest hashes: ``context, start,
    end, path, label``. The hashes alone are ordered; the largest of them then picks the texts in the scan. Rows
    that repeat id and text are one document."""
    path = F.col(f"`{path_col}`").cast("string") if path_col else F.lit(None).cast("string")
    texts = docs.filter(F.col(f"`{text_col}`").isNotNull()).select(
        F.xxhash64(f"`{id_col}`", f"`{text_col}`").alias("seed"), F.col(f"`{text_col}`").cast("string").alias("text"), path.alias("path"))
    last = texts.select("seed").orderBy("seed").limit(sample).agg(F.max("seed")).first()[0]  # eight bytes a row
    some = texts.filter(F.col("seed") <= F.lit(0 if last is None else last)).groupBy("seed").agg(
        F.first("text").alias("text"), F.first("path").alias("path"))

    def write(batches):
        for batch in batches:
            rows = [(c.encode(), s, e, p, y) for seed, text, p in zip(*(c.to_pylist() for c in batch.columns))
                    for c, s, e, y in examples(text, seed)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.float64()))],
                ["context", "start", "end", "path", "label"])

    return some.mapInArrow(write, "context binary, start bigint, end bigint, path string, label double")


def train(findings: DataFrame, words: list[str], *, trees: int = 20, depth: int = 7, seed: int = 7) -> Forest | None:
    """A forest from labelled findings ``context, start, end, path, label``; None without any."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    known = set(words)

    def measure(batches):
        for batch in batches:
            c, s, e, p, y = (x.to_pylist() for x in batch.columns)
            rows = [features(*r, known) for r in zip(c, s, e, p)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(y, pa.float64())],
                                             ["features", "label"])

    rows = findings.select("context", "start", "end", "path", "label").mapInArrow(
        measure, "features array<double>, label double").select(array_to_vector("features").alias("features"), "label")
    rows = written(rows, "examples")
    if rows.select("label").distinct().count() < 2:
        return None
    return Forest(RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(rows))


def fitted(docs: DataFrame, findings: DataFrame | None, *, sample: int, id_col: str, text_col: str,
           path_col: str | None) -> tuple[Forest | None, set[str]]:
    words = dictionary(docs, text_col)
    if findings is None:
        findings = labelled(docs, sample=sample, id_col=id_col, text_col=text_col, path_col=path_col)
    return train(findings, words), set(words)


def found(text: bytes, path: str | None, forest: Forest | None, words: set[str], limit: float):
    """``(start, end, score)`` of the secrets of one text, in bytes."""
    spans = candidates(text)
    if not spans or forest is None:
        return []
    scores = forest.score(np.array([features(text, s, e, path, words) for s, e in spans]))
    return [(s, e, x) for (s, e), x in zip(spans, scores.tolist()) if x >= limit]


def _inputs(docs, id_col, text_col, path_col):
    path = F.col(f"`{path_col}`").cast("string") if path_col else F.lit(None).cast("string")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"),
                       path.alias("path"))


def secret_findings(docs: DataFrame, findings: DataFrame | None = None, *, limit: float = 0.5, sample: int = SAMPLE,
                    id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """Every secret of every text: ``doc_id, start, length`` (code points), ``secret_sha256, score``."""
    forest, words = fitted(docs, findings, sample=sample, id_col=id_col, text_col=text_col, path_col=path_col)

    def scan(batches):
        for batch in batches:
            take, start, length, shas, scores = [], [], [], [], []
            for row, (text, path) in enumerate(zip(batch.column("text"), batch.column("path"))):
                raw = text.as_py() or b""
                for s, e, score in found(raw, path.as_py(), forest, words, limit):
                    take.append(row)
                    start.append(len(raw[:s].decode("utf-8", "replace")))
                    length.append(len(raw[s:e].decode("utf-8", "replace")))
                    shas.append(hashlib.sha256(raw[s:e]).hexdigest())
                    scores.append(round(score, 6))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(take, pa.int32())), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(shas, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "start", "length", "secret_sha256", "score"])

    return _inputs(docs, id_col, text_col, path_col).mapInArrow(
        scan, f"doc_id {id_type(docs, id_col)}, start bigint, length bigint, secret_sha256 string, score double")


def redacted(docs: DataFrame, findings: DataFrame | None = None, *, limit: float = 0.5, mark: str = "[secret]",
             sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
             path_col: str | None = "source") -> DataFrame:
    """``docs`` with all columns; every secret in a text is replaced by ``mark``."""
    forest, words = fitted(docs, findings, sample=sample, id_col=id_col, text_col=text_col, path_col=path_col)
    sign = mark.encode()

    def clean(batches):
        for batch in batches:
            texts = []
            for text, path in zip(batch.column("_text"), batch.column("_path")):
                raw = text.as_py()
                if raw is not None:
                    parts, at = [], 0
                    for s, e, _ in found(raw, path.as_py(), forest, words, limit):
                        parts += [raw[at:s], sign]
                        at = e
                    raw = b"".join([*parts, raw[at:]])
                texts.append(raw)
            cols = [pa.array(texts, pa.binary()) if n == "_text" else c
                    for n, c in zip(batch.schema.names, batch.columns) if n != "_path"]
            yield pa.RecordBatch.from_arrays(cols, [n for n in batch.schema.names if n != "_path"])

    path = F.col(f"`{path_col}`").cast("string") if path_col else F.lit(None).cast("string")
    rows = docs.withColumn("_text", F.col(f"`{text_col}`").cast("binary")).withColumn("_path", path).drop(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_path")
    return rows.mapInArrow(clean, schema).withColumn(text_col, F.col("_text").cast("string")).select(
        *[f"`{c}`" for c in docs.columns])
