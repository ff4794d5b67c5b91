"""Vector codes, licence scans and the divergence of sources against plain versions."""
from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import time

import duckdb
import numpy as np
import pytest

from hebdocast.llm import licenses, source_audit, vector_codes

VECTORS = "vec_id bigint, embedding array<float>, label int, code string, v int, error string"


# --- vector codes ----------------------------------------------------------------------------
def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return collections.Counter()
    width = len(kept[0][1]) // parts
    cut = lambda v: [tuple(v[p * width:(p + 1) * width]) for p in range(parts)]
    start = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(r[1])[p] for r in start] for p in range(parts)]
    d = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    assign = lambda v: [min((d(x, c), e) for e, c in enumerate(books[p])) for p, x in enumerate(cut(v))]
    for _ in range(rounds):
        got = [assign(v) for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v)[p] for (_, v, _), a in zip(kept, got) if a[p][1] == e]
                if mine:
                    books[p][e] = tuple(sum(c) // len(mine) for c in zip(*mine))
    got = [assign(v) for _, v, _ in kept]
    errors = [sum(x[0] for x in a) for a in got]
    labels = collections.Counter()
    for (_, _, label), e in zip(kept, errors):
        labels[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return collections.Counter((i, "".join(f"{x[1]:02x}" for x in a), e, labels[label], sha)
                               for (i, _, label), a, e in zip(kept, got, errors))


def vector_rows(n, dims=16, seed=1):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(5, dims))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 5] + 0.3 * rnd.normal(size=dims)], i % 3 if i % 7 else None)
            for i in rnd.permutation(n).tolist()]
    rows += [(3, rows[0][1], 1), (3, rows[0][1], 1), (None, rows[1][1], 2), (10_000, [0.0] * dims, 0), (10_001, [0.0] * dims, 0)]
    rows += [(20_000, None, 1), (20_001, [None] * dims, 1), (20_002, [float("nan")] + [0.0] * (dims - 1), 1),
             (20_003, [float("inf")] + [0.0] * (dims - 1), 1)]
    return rows


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], VECTORS)


@pytest.mark.parametrize("n", [300, 4])
def test_codes_equal_plain_rounds(spark, n):
    rows = vector_rows(n)
    got = collections.Counter(tuple(r) for r in vector_codes.digest(vectors(spark, rows)).collect())
    assert got == plain_codes(rows)


def test_codes_equal_sql(spark, tmp_path):
    rows = vector_rows(200, dims=24, seed=3)
    df = vectors(spark, rows)
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(vector_codes.oracle())
    got = vector_codes.digest(df).select(*want.columns).collect()
    assert len(got) == 205 and collections.Counter(tuple(r) for r in got) == collections.Counter(want.fetchall())


def test_codes_of_nothing_and_of_unequal_vectors(spark):
    assert vector_codes.digest(vectors(spark, [(1, None, 1)])).collect() == []
    assert vector_codes.digest(vectors(spark, []).limit(0)).collect() == []
    with pytest.raises(ValueError, match="one length"):
        vector_codes.codes(vectors(spark, [(1, [0.0] * 8, 1), (2, [0.0] * 16, 1)]))
    with pytest.raises(ValueError, match="don't fit"):
        vector_codes.codes(vectors(spark, [(1, [3e38] * 8, 1)]))


def test_net_displacement_is_tighter_than_drifts_and_bounds_save_distances():
    rnd = np.random.default_rng(5)
    v = (rnd.normal(size=(2000, 4, 8)) + rnd.integers(0, 4, (2000, 4, 1)) * 4) * 4096
    v = np.floor(v).astype(np.int64)
    history = [np.ascontiguousarray(v[:16].transpose(1, 0, 2))]
    unit = 2.0 * np.abs(v).max() * 8 ** 0.5 / 65_000
    bounds = vector_codes.Bounds.first(v, history[0], unit)
    spent = []
    for _ in range(6):
        new = history[-1].copy()
        for p, e in np.ndindex(4, 16):
            mine = v[bounds.code[:, p] == e, p]
            if len(mine):
                new[p, e] = mine.sum(0) // len(mine)
        history.append(new)
        bounds.rescans = 0
        bounds.assign(v, history)
        spent.append(bounds.rescans)
        exact = np.stack([((v[:, p, None] - new[p]) ** 2).sum(2) for p in range(4)], 1)
        assert (bounds.code == exact.argmin(2)).all()
        now = np.sqrt(exact.astype(float))
        net = vector_codes.net_displacement(history)[bounds.stamp, np.arange(4)[:, None], np.arange(16)]
        assert (bounds.low * unit - net <= now).all()  # lower bounds are lower
    steps = np.stack([np.sqrt(((b - a) ** 2).sum(2)) for a, b in zip(history, history[1:])])
    drift = steps[::-1].cumsum(0)[::-1]
    net = vector_codes.net_displacement(history)[:-1]
    assert (net <= drift * (1 + 1e-8)).all() and (net < 0.95 * drift).any()
    assert spent[-1] < v.shape[0] * 4 * 16 / 4


# --- licences ----------------------------------------------------------------------------------
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_base(text):
    words = TERM.findall((text or "").translate(LOWER))
    places = [(i, label) for phrase, label in licenses.BASE.items() for p in [phrase.split()]
              for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))


def test_base_places_equal_plain_search(spark, odd, empty):
    rnd = random.Random(4)
    vocabulary = ["mit", "license", "MIT", "License", "apache", "general", "PUBLIC", "public", "gnu", "é", "日本", "x1", "version", "2", "0"]
    texts = ["".join(rnd.choice(vocabulary) + rnd.choice([" ", "-", "\n", ", ", "\x00", "é", "`"]) for _ in range(rnd.randint(0, 80))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "a", 1, "k", 0.5) for i, t in enumerate(texts)], odd.schema).unionByName(odd)
    got = licenses.digest(df).collect()
    want = collections.Counter((r["doc_id"], *plain_base(r["text"])) for r in df.collect())
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert licenses.digest(empty).collect() == []


def scan(text):
    return licenses.Scanner(licenses.BASE, licenses.NOTICES, licenses.TAGS).scan(text.encode())


@pytest.mark.parametrize("text, labels, obligation", [
    ("// SPDX-License-Identifier: MIT", "mit", "permissive"),
    ("# SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 OR Apache-2.0", "apache-2.0,gpl-2.0-only-with-classpath-exception-2.0", "permissive"),
    ("/* SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 AND MIT */", "gpl-2.0-only-with-classpath-exception-2.0,mit", "weak"),
    ("SPDX-License-Identifier: GPL-2.0 OR GPL-2.0 WITH Classpath-exception-2.0", "gpl-2.0,gpl-2.0-with-classpath-exception-2.0", "weak"),
    ("SPDX-License-Identifier: (MIT OR GPL-3.0) AND MPL-2.0", "gpl-3.0,mit,mpl-2.0", "weak"),
    ("SPDX-License-Identifier: MIT OR GPL-3.0 AND MPL-2.0", "gpl-3.0,mit,mpl-2.0", "permissive"),
    ("SPDX-License-Identifier: LicenseRef-Own", "licenseref-own", "unknown"),
    ("SPDX-License-Identifier: MIT OR (GPL-2.0", "mit", "permissive"),
    ("SPDX-License-Identifier: MIT\nOR GPL-3.0", "mit", "permissive"),
    ("License: MIT/Apache-2.0", "apache-2.0,mit", "permissive"),
    ('{"license": "BSD-3-Clause"}', "bsd-3-clause", "permissive"),
    ("License: see the file of that name", "", None),
    ("SPDX-License-Identifier: )(", "", None),
    ("under the terms of the GNU Lesser General Public\n * License, version 2.1", "gpl,lgpl-2.1", "weak"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0", "restricted"),
    ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0", "permissive"),
    ("a license to use, licensed work", "", None), ("", "", None),
])
def test_notices_and_expressions(text, labels, obligation):
    got = scan(text)
    assert (got["labels"], got["obligation"]) == (labels, obligation) and (got["score"] > 0) == bool(labels)


def test_expressions_equal_a_recursive_reading():
    rnd = random.Random(9)
    names = ["mit", "mpl-2.0", "gpl-3.0", "cc-by-nc-4.0", "own-name"]

    def made(depth):
        if depth == 0 or rnd.random() < 0.3:
            name = rnd.choice(names)
            rank = licenses.OBLIGATION.get(name, licenses.UNKNOWN)
            if rnd.random() < 0.2:
                return f"{name} with font-exception-2.0", 3, licenses.WEAK if rank == licenses.STRONG else rank
            return name, 3, rank
        op = rnd.choice(["and", "or"])
        tight = 2 if op == "and" else 1
        (left, lt, lr), (right, rt, rr) = made(depth - 1), made(depth - 1)
        wrap = lambda x, t: f"({x})" if t < tight or rnd.random() < 0.2 else x
        return f"{wrap(left, lt)} {op} {wrap(right, rt)}", tight, (max if op == "and" else min)(lr, rr)

    for _ in range(300):
        text, _, rank = made(5)
        postfix = licenses.parsed(licenses.lexed(text, 0), known_only=False)
        assert licenses.evaluated(postfix)[0] == rank, text


def test_long_lines_take_linear_time():
    t = time.perf_counter()
    scan("license: mit and " * 60_000)
    scan("SPDX-License-Identifier: " + "(" * 400_000 + "mit" + ")" * 400_000)
    scan("mit license " * 100_000)
    assert time.perf_counter() - t < 20


# --- divergence of sources ------------------------------------------------------------------------
def as_rows(df, columns):
    return collections.Counter(tuple(str(r[c]) for c in columns) for r in df)


@pytest.mark.parametrize("options", [{}, {"slice_terms": 3, "block_sources": 2}])
def test_divergence_equals_sql(spark, tmp_path, options):
    rnd = random.Random(6)
    vocabulary = [f"{a}{b}" for a in ("alpha", "Beta", "gammadeltaepsilon", "é", "日本語", "o") for b in ("", "x", "longlongtail", "longlongtails")]
    rows = []
    for i in range(700):
        source, lang = f"s{rnd.randint(0, 6)}" if i % 9 else None, rnd.choice(["en", "fr", None])
        words = [rnd.choice(vocabulary[:4 + 3 * rnd.randint(1, 6)]) for _ in range(rnd.randint(0, 25))]
        rows.append((i, rnd.choice([" ", "-", "0", "\n"]).join(words), source, lang, 1))
    rows += [(1000, None, "none", "en", 1), (1001, "rare words only", "one", "de", 1), (1002, "123", "two", "de", 1), (7, "x" * 100_000, "s1", "en", 1)] * 2
    rows += [(2000 + i, "alpha " * 50, "copies", "en", 1) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n int").repartition(5)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    want = as_rows(con.sql(source_audit.ORACLE).df()[columns].to_dict("records"), columns)
    got = as_rows([r.asDict() for r in source_audit.divergence(df, **options).collect()], columns)
    assert got == want and len(got) > 300


def test_divergence_of_odd_documents(spark, odd, empty):
    docs = odd.selectExpr("*", "'l' as lang", "1.5 as value", "'t' as term")
    got = source_audit.divergence(docs, min_docs=1).collect()
    pairs = {(r["source"], r["item"]) for r in got if r["part"] == "pair"}
    assert pairs == {(a, b) for a in ("", "a", "b", "c") for b in ("", "a", "b", "c") if a != b}
    assert source_audit.divergence(empty.selectExpr("*", "'l' as lang")).collect() == []
    assert {r["value"] for r in source_audit.divergence(docs, min_docs=1000).collect()} == {0}


def test_pointer_sort_equals_a_plain_sort():
    rnd = random.Random(8)
    stems = ["a", "ab", "abcdefgh", "abcdefghi", "abcdefgh" * 3, "abcdefgh" * 12, "abcdefgh" * 12 + "z", "é" * 40, "z" * 65, "z" * 64]
    docs = [" ".join(rnd.choice(stems) for _ in range(rnd.randint(0, 30))) for _ in range(200)] + ["", "tail"]
    raw = "".join(docs).encode()  # nothing between the documents, as in an Arrow buffer
    bounds = np.concatenate([[0], np.cumsum([len(d.encode()) for d in docs])])
    text = source_audit._FOLD[np.frombuffer(raw, np.uint8)]
    starts, ends = source_audit.word_starts(text, bounds)
    words = [text[s:e].tobytes() for s, e in zip(starts, ends)]
    assert words == [w.encode() for d in docs for w in d.split()]
    order, first = source_audit.multikey_sort(text, starts, ends)
    ordered = [words[i] for i in order]
    assert ordered == sorted(words)
    assert [ordered[i] for i in first] == sorted(set(words))
