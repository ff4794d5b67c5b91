"""Quality rules, substring dedup, near-duplicates and secrets against plain versions."""
from __future__ import annotations

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from hebdocast.llm import common, near_dup, quality, secrets, stages, substring
from hebdocast.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


# --- quality rules ---------------------------------------------------------------------------
def made_documents(spark, n=120):
    rnd = random.Random(2)
    vocabulary = ["w%d" % i for i in range(400)]
    rows = []
    for i in range(n):
        lines = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 30))) for _ in range(rnd.randint(1, 8))]
        lines += ["Copyright 2020, All rights  reserved"] * (i % 2)
        rows.append((i, "\n".join(lines), f"host{i % 3}"))
    boiler = [" ".join(rnd.choice(vocabulary) for _ in range(15)) for _ in range(6)]
    rows += [(1000 + i, "\n".join([*boiler, "own words " + "z" * i]), "host0") for i in range(40)]
    clean = "\n".join(" ".join(rnd.choice(vocabulary) for _ in range(20)) for _ in range(5))
    rows += [(2000 + i, clean, "host1") for i in range(60)]  # copies of a clean document
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def test_quality_equals_sql(spark, odd, tmp_path):
    docs = made_documents(spark).unionByName(odd.select("doc_id", "text", "source"))
    got = quality.quality(docs)
    db = duckdb.connect()
    table = docs.toPandas()
    db.register("documents", table.astype({"doc_id": "Int64"}))
    want = db.sql(quality.ORACLE)
    key = lambda r: tuple(str(x) for x in r)
    rows = sorted([tuple(r[c] for c in want.columns) for r in got.collect()], key=key)
    assert rows == sorted(want.fetchall(), key=key)


def test_depleted_documents_go_and_copies_stay(spark):
    kept = {r.doc_id: r for r in quality.quality(made_documents(spark)).collect()}
    assert all(not kept[1000 + i].kept and not kept[1000 + i].base_failed for i in range(40))
    assert all(kept[2000 + i].kept for i in range(60))
    assert sum(r.kept for i, r in kept.items() if i < 1000) == sum(not r.base_failed for i, r in kept.items() if i < 1000)


def test_quality_runs_without_python(spark, odd):
    plan = quality.quality(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_quality_stage_removes_the_lines_above_the_limits(spark):
    rnd = random.Random(12)
    own = lambda n: " ".join(f"w{rnd.randrange(5000)}x" for _ in range(n))
    rows, want = [], {}
    for i in range(60):
        first, last = own(40), own(30)
        rows.append((i, f"{first}\n\nSubscribe  to page {i + 100}\n{last}\nAll rights reserved\n", f"host{i // 30}"))
        want[i] = f"{first}\n\n{last}\n"
    rows += [(100, f"All rights reserved\n{own(60)}", "elsewhere"), (None, f"{own(60)}\nAll rights reserved", "host0"),
             (None, "All rights reserved", "host0")]
    docs = spark.createDataFrame([(i, t, s, len(t)) for i, t, s in rows], "doc_id bigint, text string, source string, n_chars int")
    out = stages.quality_stage(docs)
    assert out.dtypes == docs.dtypes
    got = {r.doc_id: r for r in out.collect()}
    want |= {100: rows[60][1], None: rows[61][1].split("\n")[0]}
    assert {i: r.text for i, r in got.items()} == want and out.count() == len(want)
    assert all(r.n_chars == len(r.text) for r in got.values())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- substring dedup -------------------------------------------------------------------------
def plain_substring(docs, size):
    words = [(i, WORDS.findall(t)) for i, t in docs]
    found = collections.Counter(tuple(w[k:k + size]) for _, w in words for k in range(len(w) - size + 1))
    out = collections.Counter()
    for i, w in words:
        gone = set()
        for k in range(len(w) - size + 1):
            if found[tuple(w[k:k + size])] > 1:
                gone.update(range(k, k + size))
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[(i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("size", [4, 12, 35])
def test_substring_equals_plain_search(spark, odd, size):
    rnd = random.Random(size)
    base = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 110))) for _ in range(25)]
    period = " ".join(["a", "b", "c"] * 40)
    made = [*enumerate(base), (100, period), (101, period + " z"), (104, base[3] + " " + base[4]),
            (105, "x " * 300), (106, base[5][:60] + " q " + base[5])]
    docs = spark.createDataFrame(made, "doc_id bigint, text string").unionByName(odd.select("doc_id", "text"))
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)
                              for r in substring.substring_dedup(docs, size=size).collect())
    assert got == plain_substring(pairs(docs), size)


def test_without_repeats_keeps_columns(spark, odd):
    out = substring.without_repeats(odd, size=35)
    assert out.columns == odd.columns and out.count() == odd.count()
    untouched = {r.doc_id: r.text for r in out.collect() if r.doc_id in (2, 3, 7)}
    assert untouched == {2: None, 3: "", 7: " \n\t "}


# --- near-duplicates -------------------------------------------------------------------------
def plain_near(docs, percent=75, size=5):
    sets = []
    for _, text in docs:
        w = WORDS.findall(text.translate(LOWER))
        sets.append({tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    smallest = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            smallest[find(k)] = min(i, smallest.get(find(k), i))
    return collections.Counter((i, len(s), smallest.get(find(k))) for k, ((i, _), s) in enumerate(zip(docs, sets)))


@pytest.mark.parametrize("chunk, chunk_items", [(3, 1 << 23), (512, 1 << 23), (512, 300)])
def test_components_equal_plain_search(spark, odd, chunk, chunk_items):
    rnd = random.Random(9)
    vocabulary = ["v%d" % i for i in range(3000)]
    rows = []
    for g in range(6):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice((8, 60, 150)))]
        for _ in range(rnd.randint(2, 14)):
            copy = list(base)
            for _ in range(rnd.randint(0, 5)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append((len(rows) * 7 % 101 + 100, " ".join(copy).upper() if rnd.random() < 0.3 else " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").unionByName(odd.select("doc_id", "text"))
    out = near_dup.near_duplicates(docs, chunk=chunk, chunk_items=chunk_items).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == plain_near(pairs(docs))
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_star_steps_find_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    edges += [(500, 500 + i) for i in range(1, 50)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = components(spark.createDataFrame(edges, "u bigint, v bigint")).distinct().collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("size", [0, 1, 7, 50, 299, 300, 5000])
def test_most_frequent_equals_a_sort(spark, size):
    rnd = random.Random(4)
    rows = [(f"k{i}", rnd.choice((1, 1, 1, 2, 3, 7, 8, 9, 15, 16, 17, rnd.randint(1, 300), 2 ** rnd.randint(1, 62))))
            for i in range(300)]
    table = common.written(spark.createDataFrame(rows, "key string, freq bigint").repartition(9), "counts")
    got = [tuple(r) for r in common.most_frequent(table, "key", "freq", size).collect()]
    assert got == sorted(rows, key=lambda r: (-r[1], r[0]))[:size]
    assert common.most_frequent(table.limit(0), "key", "freq", size).collect() == []


@pytest.mark.parametrize("many", [False, True])
def test_common_items(many):
    rng = np.random.default_rng(1)
    items = [np.unique(rng.integers(0, 400, 200)) for _ in range(12)]
    left, right = np.triu_indices(12, 1)
    if not many:
        left, right = left[:5], right[:5]
    else:
        left, right = np.tile(left, 2), np.tile(right, 2)
    want = [len(np.intersect1d(items[i], items[j])) for i, j in zip(left, right)]
    assert near_dup.common_items(items, left, right).tolist() == want


def test_copies_dont_hide_the_lines_that_the_other_pages_share(spark):
    rnd = random.Random(12)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    boiler, copy = words(90), "\n".join(words(20) for _ in range(4))
    rows = [(i, copy, "host") for i in range(900)]
    rows += [(1000 + i, f"{boiler}\n{words(15)}" if i < 40 else "\n".join(words(20) for _ in range(4)), "host") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = {r.doc_id: (r.n_boilerplate_words, r.kept) for r in quality.quality(docs).collect()}
    assert all(out[1000 + i] == (90, False) for i in range(40)) and all(out[i] == (0, True) for i in range(900))
    assert all(out[1000 + i] == (0, True) for i in range(40, 100))


# --- secrets ---------------------------------------------------------------------------------
def prose(rnd, n=300):
    syllables = ["an", "ther", "tion", "re", "ble", "ing", "ou", "sta", "men"]
    return " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def test_forest_on_held_out_findings(spark):
    rnd = random.Random(1)
    docs = spark.createDataFrame([(i, prose(rnd), "src") for i in range(300)], "doc_id bigint, text string, source string")
    forest, words = secrets.fitted(docs, None, sample=200, id_col="doc_id", text_col="text", path_col="source")
    label, score = [], []
    for i in range(200):
        for context, s, e, y in secrets.examples(prose(rnd), 10_000 + i):
            label.append(y)
            score.append(forest.score(np.array([secrets.features(context.encode(), s, e, "src", words)]))[0])
    hit = (np.array(score) >= 0.5) == np.array(label)
    assert hit.mean() > 0.95


def test_secrets_are_found_and_replaced(spark):
    rnd = random.Random(3)
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(i, prose(rnd), "src") for i in range(200)]
    rows += [(500, f'été {prose(rnd, 20)} token = "{key}" {prose(rnd, 20)}', None),
             (501, f"{prose(rnd, 20)} commit {key} {prose(rnd, 20)}", "src"), (502, None, "src"), (None, "", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = secrets.secret_findings(docs).collect()
    assert [(r.doc_id, r.length) for r in found] == [(500, 40)]
    text = dict((i, t) for i, t, _ in rows)
    assert text[500][found[0].start:found[0].start + 40] == key
    out = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    assert out.pop(500) == text.pop(500).replace(key, "[secret]") and out == text


# Written by hand, in formats that the forest's examples don't have; the parts are joined here alone.
FOREIGN = [
    "SLACK_BOT_TOKEN=xoxb" + "-263594206564-2343594206574-FGqddMF8t08v8N7Oq4i57vs1", "gitlab_token: glpat" + "-zX4k9QmB2vT7yR1cNpLd",
    'maps_api_key = "AIza' + 'SyD3k9Xw7LqPz0mNvB5tRyU2iOeHgFaCsJk"', "SENDGRID_API_KEY='SG" + ".ngeVfQFYQlKU0ufo8x5d1A.TwL2iGABf9DHoTf09kqeF8tAmbihYzrnopKc1s5cr'",
    "//registry.npmjs.org/:_authToken=npm" + "_b3Kq8XzW1mPv6TyLr0NdJf5HsGc9EaUo2iQw", "export HF_TOKEN=hf" + "_QmZxKvRtYpWnBsDfGhJkLcVbNmAqWeRtYu",
    "Authorization: Bearer ya29" + ".a0AfH6SMBx7KqZp3vWnT9yLrD5mJcGs2HfEoUiQaXbVwRtYzNk", "shopify_secret: shpat" + "_f09c3b7a1e5d482690bc7fe13a5d8246",
    'client_secret = "Vx8~' + 'Q.7kLm2Np9RtS-wXyZ3aBcDeFgHiJ4kL5mN"', "DOCKER_PASSWORD=dckr" + "_pat_8KfZqW3xVn6TyBmRj0LsPdHc2Ga",
    "db_password: 9f$K!" + "vz2Qm@rT7pL", 'twilio_auth = "SK' + '3b8f1c9e7a2d4560b1f8e3c7d9a2f5b4"', "aws_secret_access_key = wJa9" + "lrXUtnFEMI/K7MDENG/bPxRfiCYzQw8Lk3Vt",
    'pwd="tR8#' + 'mK2$wZ9!qB"', "api-key: 7Hq2" + "Zk9XvBn4Tm1YpLw6Rc3Jd8Fs5GaUe0Ki", "secret=ey" + "JhbGciOi.eyJzdWIiOiIxMjM0NTY3ODkwIiwibmFt.SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJV"]
HARMLESS = [
    'integrity sha512 d3b07384d113edec49eaa6238ad5ff00d3b07384d113edec49eaa6238ad5ff00', "commit 9fceb02d0ae598e95dc970b74767f19372d61af8",
    "uuid: 550e8400-e29b-41d4-a716-446655440000", "see https://docs.example.org/guide/getting-started-with-the-library", "token = your_token_here",
    'password = "changeme123"', "secret: ${VAULT_SECRET_NAME}", "isbn 978-3-16-148410-0 and 9783161484100123", "----------------------------------------",
    "the functionNameThatIsVeryLongAndDescriptive was called", "a file at /usr/local/share/applications/defaults/list", "md5: 5d41402abc4b2a76b9719d911017c592",
    "mail to averylongmailboxname@example.com today", "password: ************", "checksum e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
    "reallyreallyreallyreallylongword of nothing"]


def test_forest_on_keys_written_by_hand(spark):
    """Recall and precision of whole documents, given ones around the keys and their look-alikes."""
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    clean = [r.text for r in given.where("length(text) between 400 and 3000 and lang = 'en'").limit(80).collect()]
    rows = [(10**6 + i, f"{clean[i][:300]}\n{x}\n{clean[i][300:]}", "src1") for i, x in enumerate(FOREIGN)]
    rows += [(2 * 10**6 + i, f"{clean[40 + i][:300]}\n{x}\n{clean[40 + i][300:]}", "src1") for i, x in enumerate(HARMLESS)]
    docs = given.unionByName(spark.createDataFrame(rows, given.schema))
    planted = {(r.doc_id, m.start(1), 40) for r in given.collect() for m in re.finditer(r'token = "([0-9a-f]{40})"', r.text or "")}
    found = {(r.doc_id, r.start, r.length) for r in secrets.secret_findings(docs).collect()}
    of = lambda low, high: {f[0] for f in found if low <= f[0] < high}
    hits, false = of(10**6, 2 * 10**6), of(2 * 10**6, 3 * 10**6)
    assert len(planted) == 13 and len(planted & found) >= 12
    assert len(hits) >= 0.9 * len(FOREIGN), sorted(set(range(len(FOREIGN))) - {i - 10**6 for i in hits})
    others = {f for f in found if f[0] < 10**6} - planted
    right = len(hits) + len(planted & found)
    assert right / (right + len(false) + len(others)) >= 0.9, (sorted(false), sorted(others))


def test_secrets_of_long_texts_ties_and_repeated_rows(spark):
    rnd = random.Random(21)
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    line = f'{prose(rnd, 20)} token = "{key}" {prose(rnd, 20)}'
    long = " ".join([prose(rnd, 40_000), line, prose(rnd, 40_000), line])
    rows = [(i, prose(rnd), "src") for i in range(200)] + [(500, line, "src")] * 3 + [(501, long, "src"), (502, "x" * 300_000, "src")]
    docs = spark.createDataFrame([(*r, 1, "a") for r in rows], "doc_id bigint, text string, source string, score int, start string")
    found = collections.Counter((r.doc_id, r.start) for r in secrets.secret_findings(docs).collect() if r.doc_id >= 500)
    assert found == {(500, line.index(key)): 3, (501, long.index(key)): 1, (501, long.rindex(key)): 1}
    out = secrets.redacted(docs)
    assert out.columns == docs.columns and out.where("doc_id = 501 and text like '%04dbebab%'").count() == 0
    assert out.where("doc_id = 500").count() == 3


def test_examples_come_from_whole_texts_and_copies_count_once(spark):
    rows = [(1, "same text " * 5, "s")] * 500 + [(i, f"{'early ' * 3000}late{chr(97 + i % 26)}", "s") for i in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(7)
    made = secrets.labelled(docs, sample=1000, id_col="doc_id", text_col="text", path_col="source").collect()
    texts = [bytes(r.context).decode() for r in made]
    assert len(made) < 30 * 19 and any("late" in t for t in texts) and sum("same" in t for t in texts) < 40


def test_given_findings_train_the_forest(spark):
    rows = [(f'token = "{"a1" * 10}{i:04d}"'.encode(), 9, 33, None, 1.0) for i in range(40)]
    rows += [(f"see file {'b2' * 10}{i:04d} here".encode(), 9, 33, None, 0.0) for i in range(40)]
    findings = spark.createDataFrame(rows, "context binary, start bigint, end bigint, path string, label double")
    docs = spark.createDataFrame([(1, 'x token = "a9a9a9a9a9a9a9a9a9a9a9a9"'), (2, "see file b8b8b8b8b8b8b8b8b8b8b8b8 here")],
                                 "doc_id bigint, text string")
    assert [r.doc_id for r in secrets.secret_findings(docs, findings, path_col=None).collect()] == [1]


def test_long_and_letters_only_secrets_are_replaced_whole(spark):
    rnd = random.Random(5)
    pick = lambda n, chars="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789": "".join(rnd.choice(chars) for _ in range(n))
    long = "%2B".join(pick(12) for _ in range(40))
    letters = pick(40, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
    rows = [(i, prose(rnd), "src") for i in range(200)]
    rows += [(500, f'{prose(rnd, 20)} bearer_token = "{long}" {prose(rnd, 20)}', "src"),
             (501, f"{prose(rnd, 20)} {letters} {prose(rnd, 20)}", "src")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    text = dict((i, t) for i, t, _ in rows)
    want = text | {500: text[500].replace(long, "[secret]"), 501: text[501].replace(letters, "[secret]")}
    assert out == want


def test_coverage_takes_the_whole_candidate():
    assert secrets.coverage("word" * 100 + "q7" * 200, {"word"}) == 0.5


# --- all of them -----------------------------------------------------------------------------
def test_empty_tables(empty):
    assert quality.quality(empty).collect() == []
    assert substring.substring_dedup(empty).collect() == []
    assert near_dup.near_duplicates(empty).collect() == []
    assert secrets.secret_findings(empty).collect() == []
    assert secrets.redacted(empty).collect() == []


def test_stages_return_the_documents(odd):
    for stage in (stages.quality_stage, stages.near_dup_stage, stages.substring_stage, stages.secrets_stage):
        out = stage(odd)
        assert out.columns == odd.columns and out.dtypes == odd.dtypes
        assert out.count() <= odd.count()
