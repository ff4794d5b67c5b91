"""Quality rules with a cross-document line frequency, in DataFrame functions only.

Base rules look at one text: its words, symbols, repeated lines and repeated three-word windows.
The method's rule looks across documents: every distinct line of a text is normalised (ASCII lower
case, digits as 0, white space as one space, trimmed) and hashed, and a line counts, per host, the
distinct documents that hold it. Copies of one document must not make its lines look like
boilerplate, so documents with the same set of lines count once, for the line and for its host. Lines of more documents than both
limits are removed, and a document that keeps less than ``min_left`` of its words is rejected.
:func:`quality` gives the counters and the verdict of every row, :func:`cleaned` the documents that pass,
without those lines.

Scale: texts are read once, without a shuffle, into a table of counters and line hashes, which is
what all later steps read. Line counts are grouped by (host, line), so a host with a third of all
rows is spread over its lines, and a line of a third of all rows is counted before the shuffle; only
the line hashes of distinct documents move. Lines above the limits come back by a join whose large side
Spark may split.

Defined results: a null text has no words and fails the base rules; null hosts are one host; a null
id is kept; every row gives one row, repeated ones too; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, hashes, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"  # fixed value


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where lambdas use it many times."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the list. Windows are compared
    by 64-bit hashes within the one text."""

    def count(tri: Column) -> Column:
        def repeats(ordered: Column) -> Column:
            n = F.size(ordered)
            twin = F.filter(ordered, lambda w, j: ((j > 0) & (F.get(ordered, j - 1)["h"] == w["h"]))
                            | ((j + 1 < n) & (F.get(ordered, j + 1)["h"] == w["h"])))
            starts = F.sort_array(F.transform(twin, lambda w: w["i"]))
            # a window at p adds the words that the window before it doesn't cover
            return F.aggregate(
                starts, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n")),
                lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
                lambda a: a["n"])

        ordered = F.sort_array(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(tri)) == F.size(tri), F.lit(0).cast("bigint")).otherwise(
            let(ordered, repeats))

    def windows(h: Column) -> Column:
        return F.when(F.size(h) < 3, F.lit(0).cast("bigint")).otherwise(
            let(F.transform(F.slice(h, 1, F.size(h) - 2),
                            lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))), count))

    return let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def normalised(line: Column) -> Column:
    lower = F.translate(line, UPPER + "123456789", LOWER + "0" * 9)
    return F.trim(F.regexp_replace(lower, r"[\x20\x09-\x0D]+", " "))


def profile(docs: DataFrame, *, id_col: str, text_col: str, host_col: str, with_keys: bool = False) -> DataFrame:
    """Counters of every text and the hashes of its distinct normalised lines (and ``k1, k2`` of id, text and host)."""
    k1, k2 = hashes(id_col, text_col, host_col)
    keys = [k1.alias("k1"), k2.alias("k2")] if with_keys else []
    base = docs.select(*keys, F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{host_col}`").cast("string").alias("host"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    parts = base.withColumn("words", words_of(F.col("text"))).withColumn(
        "lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0))
    norm = F.transform("lines", normalised)

    return parts.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "host", *(["k1", "k2"] if with_keys else []),
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.sort_array(F.array_distinct(F.transform(norm, lambda x: F.xxhash64(x)))).alias("distinct_lines"),
        # hash and words of every line, repeated ones too
        F.transform(norm, lambda x: F.struct(
            F.xxhash64(x).alias("line"), F.size(F.split(x, " ")).alias("words"))).alias("all_lines"))


def frequent_lines(profiles: DataFrame, *, min_docs: int, min_share: float) -> DataFrame:
    """``host, line`` of the lines above both limits."""
    # Documents with one set of lines are one row, before their lines move.
    sets = profiles.groupBy("host", F.xxhash64("distinct_lines").alias("document")).agg(
        F.first("distinct_lines").alias("distinct_lines"))
    lines = sets.select("host", F.explode("distinct_lines").alias("line"))
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"))
    # the same documents, so that copies make neither a line's share larger nor the host's
    hosts = profiles.select("host", F.xxhash64("distinct_lines").alias("document")).distinct().groupBy("host").agg(
        F.count(F.lit(1)).alias("host_docs"))
    often = counts.filter(F.col("n_docs") > min_docs)
    return often.join(hosts, often.host.eqNullSafe(hosts.host)).filter(
        F.col("n_docs") > min_share * F.col("host_docs")).select(often.host, "line")


def judged(profiles: DataFrame, lost: DataFrame, *, min_words: int, max_repeat_percent: int,
           min_left: float) -> DataFrame:
    """``profiles`` with ``base_failed, kept, n_boilerplate_words``; ``lost`` has the last for some rows."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = F.col("n_words") - F.col("n_boilerplate_words")
    return (profiles.drop("distinct_lines", "all_lines").join(lost, "row", "left")
            .withColumn("n_boilerplate_words", F.coalesce("n_boilerplate_words", F.lit(0).cast("bigint")))
            .withColumn("base_failed", failed)
            .withColumn("kept", ~failed & (left >= min_left * F.col("n_words"))))


def lost_lines(profiles: DataFrame, often: DataFrame) -> DataFrame:
    """``row, line, words`` of the lines above the limits, repeated ones too."""
    lines = profiles.select("row", "host", F.explode("all_lines").alias("x")).select("row", "host", "x.*")
    return lines.join(often, lines.host.eqNullSafe(often.host) & (lines.line == often.line), "left_semi")


def quality(docs: DataFrame, *, min_words: int = 50, max_repeat_percent: int = 50, min_docs: int = 20,
            min_share: float = 0.05, min_left: float = 0.25, id_col: str = "doc_id",
            text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_boilerplate_words`` of every row."""
    profiles = written(profile(docs, id_col=id_col, text_col=text_col, host_col=host_col), "profiles")
    often = frequent_lines(profiles, min_docs=min_docs, min_share=min_share)
    lost = lost_lines(profiles, often).groupBy("row").agg(F.sum("words").alias("n_boilerplate_words"))
    rows = judged(profiles, lost, min_words=min_words, max_repeat_percent=max_repeat_percent, min_left=min_left)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", "kept", "n_boilerplate_words")


def cleaned(docs: DataFrame, *, min_words: int = 50, max_repeat_percent: int = 50, min_docs: int = 20,
            min_share: float = 0.05, min_left: float = 0.25, id_col: str = "doc_id",
            text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``docs`` with all columns: the rows that :func:`quality` keeps, their texts without the lines above
    the limits."""
    profiles = written(profile(docs, id_col=id_col, text_col=text_col, host_col=host_col, with_keys=True), "profiles")
    often = frequent_lines(profiles, min_docs=min_docs, min_share=min_share)
    lost = lost_lines(profiles, often).groupBy("row").agg(
        F.sum("words").alias("n_boilerplate_words"), F.collect_set("line").alias("lines"))
    rows = judged(profiles, lost, min_words=min_words, max_repeat_percent=max_repeat_percent, min_left=min_left)
    # Rows of one id, text and host have one verdict; only rejected rows and those that lose lines are joined.
    changed = rows.filter("not kept or lines is not null").groupBy("k1", "k2").agg(
        F.first("kept").alias("_kept"), F.first("lines").alias("_lines"))
    changed = written(changed.withColumnsRenamed({"k1": "_k1", "k2": "_k2"}), "changed")
    discard(profiles)
    found = docs.withColumns(dict(zip(("_k1", "_k2"), hashes(id_col, text_col, host_col)))).join(
        changed.hint("shuffle_hash"), ["_k1", "_k2"], "left").filter("_kept is null or _kept")
    text = F.col(f"`{text_col}`")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(
        F.col("_lines"), F.xxhash64(normalised(x)))), "\n")
    return found.withColumn(text_col, F.when(F.col("_lines").isNull(), text).otherwise(left)).select(
        *[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word,
             generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
t AS (SELECT r, i, word, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3
      FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, word, w2, w3) AS n FROM t
                          WHERE w3 IS NOT NULL) WHERE n > 1),
rw AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
wc AS (SELECT r, count(*) AS n, sum(length(word)) AS chars FROM w GROUP BY r),
raw AS (SELECT r, host, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT r, host, line, md5(norm) AS h, len(string_split(norm, ' ')) AS words
      FROM (SELECT *, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789',
                   'abcdefghijklmnopqrstuvwxyz000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
            FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]'))),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l GROUP BY r),
dl AS (SELECT DISTINCT r, host, h FROM l),
doc AS (SELECT r, host, string_agg(h, ' ' ORDER BY h) AS lines FROM dl GROUP BY r, host),
one AS (SELECT min(r) AS r FROM doc GROUP BY host, lines),
cnt AS (SELECT host, h, count(*) AS n FROM dl JOIN one USING (r) GROUP BY host, h),
hosts AS (SELECT d.host, count(DISTINCT coalesce(doc.lines, '')) AS n FROM d LEFT JOIN doc ON d.r = doc.r GROUP BY d.host),
often AS (SELECT c.host, c.h FROM cnt c JOIN hosts x ON c.host IS NOT DISTINCT FROM x.host
          WHERE c.n > 20 AND c.n > 0.05 * x.n),
lost AS (SELECT l.r, sum(l.words) AS n FROM l JOIN often o ON l.host IS NOT DISTINCT FROM o.host AND l.h = o.h
         GROUP BY l.r),
s AS (SELECT d.doc_id, coalesce(wc.n, 0)::BIGINT AS n_words, coalesce(wc.chars, 0)::BIGINT AS word_chars,
       (length(d.text) - length(translate(d.text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
       coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rw.n, 0)::BIGINT AS n_repeat_words,
       coalesce(lost.n, 0)::BIGINT AS n_boilerplate_words
      FROM d LEFT JOIN wc USING (r) LEFT JOIN dup USING (r) LEFT JOIN rw USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND n_words - n_boilerplate_words >= 0.25 * n_words AS kept, n_boilerplate_words
FROM s
"""
