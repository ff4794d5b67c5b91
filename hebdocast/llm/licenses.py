"""Licence notices and identifier tags of texts, with the meaning of licence expressions.

One Aho-Corasick automaton runs over the words of a text (ASCII lower-cased, single spaces) and finds notice
phrases; another runs over its raw bytes and finds identifier tags (``SPDX-License-Identifier:``, ``License:`` and
the like). What follows a tag on its line is read as a licence expression by a shunting-yard parser: ``with``
binds before ``and``, ``and`` before ``or``, parentheses as usual. An expression is evaluated to its
obligation: ``or`` lets the user choose the lesser one, ``and`` takes the greater, ``with`` a known exception makes
a strong copyleft a weak one.

Labels: base phrases give theirs at every place. A notice phrase of the method's own gives its label where
no longer notice covers it; a tag gives a label for each licence of its expression, ``licence-with-exception`` for an
exception. The score is 1 minus the product of (1 - weight) over the distinct labels, each with its strongest
evidence: 0.95 a tag, 0.8 a notice of four words or more, 0.6 a shorter one.

Scale: a row of findings for every row of the input, one pass and no shuffle. Work and memory are linear in the length
of a text: nothing recurses, expressions are never multiplied out, nested parentheses only deepen a stack.

Defined results: a null text is empty; texts without words or findings have no labels and score 0; a null id is kept; every
row gives one row, repeated ones too; other columns are ignored; an empty table gives no rows. A tag whose line
holds no licence expression at its start gives nothing; ``spdx`` tags also accept unknown names (obligation unknown).
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, pick, worker_for

# Phrases and labels of the base.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# The method's own notices.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "apache license version 2 0": "apache-2.0",
    "apache license 2 0": "apache-2.0",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "version 2 of the gnu general public license": "gpl-2.0",
    "version 3 of the gnu general public license": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu lesser general public license version 2 1": "lgpl-2.1",
    "gnu lesser general public license version 3": "lgpl-3.0",
    "gnu affero general public license": "agpl",
    "gnu affero general public license version 3": "agpl-3.0",
    "mozilla public license": "mpl",
    "mozilla public license version 2 0": "mpl-2.0",
    "mozilla public license 2 0": "mpl-2.0",
    "eclipse public license": "epl",
    "eclipse public license version 2 0": "epl-2.0",
    "bsd license": "bsd",
    "2 clause bsd license": "bsd-2-clause",
    "3 clause bsd license": "bsd-3-clause",
    "bsd 2 clause license": "bsd-2-clause",
    "bsd 3 clause license": "bsd-3-clause",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "isc license": "isc",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "zlib license": "zlib",
    "boost software license": "bsl-1.0",
    "artistic license 2 0": "artistic-2.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "cc0 1 0 universal": "cc0-1.0",
    "cc by 3 0": "cc-by-3.0",
    "cc by 4 0": "cc-by-4.0",
    "cc by sa 3 0": "cc-by-sa-3.0",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "cc by nd 4 0": "cc-by-nd-4.0",
    "cc by nc 3 0": "cc-by-nc-3.0",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by nc sa 4 0": "cc-by-nc-sa-4.0",
    "cc by nc nd 4 0": "cc-by-nc-nd-4.0",
    "creative commons attribution 4 0": "cc-by-4.0",
    "creative commons attribution sharealike 4 0": "cc-by-sa-4.0",
    "creative commons attribution noncommercial 4 0": "cc-by-nc-4.0",
}
TAGS = ("spdx-license-identifier:", "license:", "licence:", "license-expression:", '"license":', "license =")

# Obligations in rising order, and the licences of each (names as in expressions, lower case).
CLASSES = ("permissive", "weak", "strong", "restricted", "unknown")
PERMISSIVE, WEAK, STRONG, RESTRICTED, UNKNOWN = range(5)
LICENCES = {
    PERMISSIVE: "0bsd afl-3.0 apache apache-1.1 apache-2.0 artistic-2.0 bsd bsd-2-clause bsd-3-clause bsl-1.0 cc-by-3.0 "
                "cc-by-4.0 cc0-1.0 isc mit mit-0 ncsa openssl postgresql psf-2.0 python-2.0 unicode-3.0 unlicense wtfpl x11 zlib",
    WEAK: "cddl-1.0 cddl-1.1 cpl-1.0 epl epl-1.0 epl-2.0 eupl-1.2 lgpl lgpl-2.0 lgpl-2.0-only lgpl-2.0-or-later lgpl-2.1 "
          "lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later mpl mpl-1.1 mpl-2.0 ms-rl",
    STRONG: "agpl agpl-3.0 agpl-3.0-only agpl-3.0-or-later cc-by-sa-3.0 cc-by-sa-4.0 gpl gpl-2.0 gpl-2.0-only "
            "gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later osl-3.0",
    RESTRICTED: "cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 busl-1.1 sspl-1.0",
}
OBLIGATION = {name: rank for rank, names in LICENCES.items() for name in names.split()}
EXCEPTIONS = frozenset("autoconf-exception-3.0 bison-exception-2.2 classpath-exception-2.0 font-exception-2.0 gcc-exception-3.1 "
                       "linux-syscall-note llvm-exception openssl-exception".split())

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACES = re.compile(rb"  +")
_TOKEN = re.compile(r"[ \t\"'\[]*(?:([()])|([a-z0-9][a-z0-9.+-]*))")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def automaton(patterns) -> ahocorasick.Automaton:
    """Patterns with their values, over strings of one character a byte."""
    found = ahocorasick.Automaton()
    for pattern, value in patterns:
        found.add_word(pattern, value)
    found.make_automaton()
    return found


def stream(text: bytes) -> str:
    """The words of a text between single spaces, a character a byte."""
    return _SPACES.sub(b" ", b" " + text.translate(_WORDS) + b" ").decode("latin-1")


def notices(words: str, phrases: ahocorasick.Automaton) -> list[tuple[int, int, str | None, str | None]]:
    """``(first word, words, base label, own label)`` of every phrase, in order of their ends."""
    out, spaces, at = [], 0, 0
    for end, (n, base, own) in phrases.iter(words):
        spaces += words.count(" ", at, end)
        at = end
        out.append((spaces - n, n, base, own))
    return out


def uncovered(found: list) -> list[tuple[int, int, str]]:
    """Notices with their own label (a base phrase: its base label) that don't lie inside a longer one."""
    out, reach = [], -1
    for first, n, base, own in sorted(found, key=lambda f: (f[0], -f[1])):
        if first + n > reach:
            out.append((first, n, own or base))
            reach = first + n
    return out


def lexed(text: str, at: int):
    """Tokens from a place of a text on, up to the first sign that expressions don't have, such as the end of the
    line; ``/`` after a token is ``or``."""
    begun = False
    while True:
        found = _TOKEN.match(text, at)
        if found:
            begun, at = True, found.end()
            yield found[1] or found[2]
        elif begun and text[at:at + 1] == "/":
            at += 1
            yield "or"
        else:
            return


def parsed(tokens, known_only: bool) -> list[str] | None:
    """Postfix form of the longest expression at the start of ``tokens`` (shunting-yard), or None.

    Names stand where operands are due, operators elsewhere; the expression ends where that no longer holds. Operators
    and parentheses left open at the end are taken back with what follows them."""
    out: list[str] = []
    stack: list[str] = []
    due, depth = True, 0
    whole = None  # postfix length at the last place where the expression could end, with all parentheses closed
    tail: list[str] = []
    for token in tokens:
        if due and token == "(":
            stack.append(token)
            depth += 1
        elif due and token not in PRECEDENCE and token not in "()":
            known = token.rstrip(".") in OBLIGATION or token.rstrip(".").removesuffix("+") in OBLIGATION
            if bool(stack) and stack[-1] == "with":
                known = True
            if known_only and not known:
                break
            out.append(token.rstrip("."))
            due = False
        elif not due and token == ")" and depth:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        elif not due and token in PRECEDENCE:
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
            due = True
        else:
            break
        if not due and not depth:
            whole, tail = len(out), stack[::-1]
    if whole is None:
        return None
    return out[:whole] + tail


def evaluated(postfix: list[str]) -> tuple[int, list[str]]:
    """Obligation of an expression and the labels of its licences."""
    stack: list[tuple[int, int]] = []  # obligation, place of its label or -1
    labels: list[str | None] = []
    for token in postfix:
        if token == "with":
            (_, exception), (rank, licence) = stack.pop(), stack.pop()
            if licence >= 0:
                if exception >= 0:
                    labels[licence] = f"{labels[licence]}-with-{labels[exception]}"
                    if rank == STRONG and labels[exception] in EXCEPTIONS:
                        rank = WEAK
            if exception >= 0:
                labels[exception] = None
            stack.append((rank, licence))
        elif token in PRECEDENCE:
            (right, _), (left, _) = stack.pop(), stack.pop()
            stack.append((min(left, right) if token == "or" else max(left, right), -1))
        else:
            stack.append((OBLIGATION.get(token, OBLIGATION.get(token.removesuffix("+"), UNKNOWN)), len(labels)))
            labels.append(token)
    return stack[0][0], [x for x in labels if x is not None]


def rendered(postfix: list[str]) -> str:
    """The expression in postfix order, which needs no parentheses."""
    return " ".join(postfix)


class Scanner:
    """Automata of a set of phrases and tags; :meth:`scan` gives the findings of one text."""

    def __init__(self, base: dict[str, str], own: dict[str, str], tags):
        self.phrases = automaton((f" {x} ", (x.count(" ") + 1, base.get(x), own.get(x))) for x in {**base, **own})
        self.tags = automaton((x, x.startswith("spdx")) for x in tags)
        self.stems = sorted({x.lstrip('"')[:5] for x in tags})

    def scan(self, text: bytes) -> dict:
        words = stream(text)
        found = notices(words, self.phrases)
        base = [f for f in found if f[2]]
        own = uncovered(found)
        weight: dict[str, float] = {}
        worst = -1
        for _, n, label in own:
            weight[label] = max(weight.get(label, 0), 0.8 if n >= 4 else 0.6)
            worst = max(worst, OBLIGATION.get(label, UNKNOWN))
        for _, _, label, _ in base:
            weight[label] = max(weight.get(label, 0), 0.6)
        expressions = []
        low = text.translate(_LOWER).decode("latin-1")
        if any(stem in low for stem in self.stems):
            for end, spdx in self.tags.iter(low):
                postfix = parsed(lexed(low, end + 1), known_only=not spdx)
                if postfix:
                    rank, labels = evaluated(postfix)
                    worst = max(worst, rank)
                    weight.update(dict.fromkeys(labels, 0.95))
                    expressions.append((end + 1, _text(rendered(postfix)), CLASSES[rank]))
        doubt = 1.0
        for label in sorted(weight):
            doubt *= 1 - weight[label]
        return {"n_words": max(words.count(" ") - 1, 0), "n_base": len(base),
                "first_word": min((f[0] for f in base), default=None), "last_word": max((f[0] for f in base), default=None),
                "base_labels": ",".join(sorted({f[2] for f in base})), "labels": ",".join(sorted(weight)),
                "score": round(1 - doubt, 9), "obligation": None if worst < 0 else CLASSES[worst],
                "notices": [{"word": f, "words": n, "label": label} for f, n, label in own],
                "expressions": [{"byte": at, "postfix": x, "obligation": o} for at, x, o in expressions]}


def _text(latin: str) -> str:
    return latin.encode("latin-1").decode("utf-8", "replace")


FIELDS = pa.schema([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("obligation", pa.string()),
    ("notices", pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("label", pa.string())]))),
    ("expressions", pa.list_(pa.struct([("byte", pa.int64()), ("postfix", pa.string()), ("obligation", pa.string())])))])
SCHEMA = ("doc_id {id}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
          "score double, obligation string, notices array<struct<word: bigint, words: bigint, label: string>>, "
          "expressions array<struct<byte: bigint, postfix: string, obligation: string>>")


def license_scan(docs: DataFrame, *, base: dict[str, str] = BASE, own: dict[str, str] = NOTICES, tags=TAGS,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every row: ``doc_id, n_words``; places of base phrases ``n_base, first_word, last_word, base_labels``; all
    ``labels`` and their ``score``; the greatest ``obligation`` found; the ``notices`` (words and place) and the
    ``expressions`` of tags (place in bytes, postfix form, obligation). ``base`` and ``own`` map phrases (words
    between single spaces) to labels, ``tags`` are raw lower-case strings; those that begin with ``spdx`` accept unknown names."""

    def run(batches):
        worker_for("licenses")
        scanner = Scanner(base, own, tags)
        for batch in batches:
            rows = [scanner.scan(x.as_py()) for x in batch.column("text")]
            found = pa.RecordBatch.from_pylist(rows, schema=FIELDS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *found.columns], names=["doc_id", *FIELDS.names])

    return pick(docs, id_col, text_col).mapInArrow(run, SCHEMA.format(id=id_type(docs, id_col)))


def digest(docs: DataFrame, **options) -> DataFrame:
    """The columns of :func:`license_scan` without the lists of findings."""
    return license_scan(docs, **options).drop("notices", "expressions")
