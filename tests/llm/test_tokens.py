"""Token ids, packing, counts, BPE and token files against the tokenizers library."""
from __future__ import annotations

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from hebdocast.llm import bpe, packing, token_counts, token_file
from hebdocast.llm.common import written
from hebdocast.llm.tokens import Tokens


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


def encoded(path, text):
    tok = Tokenizer.from_file(path)
    return tok.encode(text, add_special_tokens=False).ids


STRANGE = ["", " ", "a\n\n b  c", "x<|endoftext|>  y <|startoftext|>z  <|endoftext|>", "İstanbul Ça don't DON'T I'LL 12½²³ ſ Dž",
           "日本語 テスト 𝔘 Σας ΟΔΟΣ", "a b   c", "\x1c\x1d a\x1cb", "  lead", "trail  ", "\t\ttab\r\n\r\nx",
           "á̧ o̸", "<| end <|endoftext|", "x" * 300 + " " + "é" * 200]


@pytest.mark.parametrize("kind", ["word_bpe", "byte_bpe"])
def test_ids_equal_the_library(kind, request):
    path = request.getfixturevalue(kind)
    rnd = random.Random(3)
    alphabet = "abcXYZ'’ÀéÖßıİŉǰ \n\t 12²½ªº·×$.,|<>#­́ʰɏẞΣ日"
    made = STRANGE + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 50))) for _ in range(800)]
    table = Tokens(path)
    for text in made:
        assert table.ids(text.encode()) == table.whole(text.encode()), text


def test_packing_places_every_token(spark, odd, word_bpe):
    rows = packing.packed(odd, word_bpe, max_tokens=512).collect()
    want = Counter()
    for _, text in texts_of(odd):
        ids = encoded(word_bpe, text) + [1]
        for at in range(0, len(ids), 512):
            part = ids[at:at + 512]
            want[(at // 512, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))] += 1
    assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(r.length for r in rows)
    assert len(places) <= -(-total // 512) + 1


def test_packing_holds_every_capacity(spark):
    rnd = random.Random(1)
    lengths = [rnd.randint(1, 100) for _ in range(3000)]
    pieces = written(spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "k long, length long"), "test")
    for rule in ("norm", "dot"):
        rows = packing.pack(pieces, max_tokens=100, max_docs=3, max_cost=6000 + 4000, rule=rule, group=1000).collect()
        assert sorted(r.k for r in rows) == list(range(3000))
        bins = defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append(r.length)
        assert all(sum(b) <= 100 and len(b) <= 3 and sum(x * x for x in b) <= 10_000 for b in bins.values())
        assert len(bins) <= 1.15 * max(sum(lengths) / 100, len(lengths) / 3)
    with pytest.raises(Exception, match="larger than"):
        packing.pack(pieces, max_tokens=50).collect()


def test_sequences_hold_the_ids(spark, odd, word_bpe):
    out = packing.sequences(odd, word_bpe, max_tokens=1024).collect()
    assert all(len(r.ids) == 4 * r.n_tokens <= 4096 for r in out)
    assert sum(r.n_tokens for r in out) == sum(len(encoded(word_bpe, t)) + 1 for _, t in texts_of(odd))


@pytest.mark.parametrize("hot", [0, 3, 65536])
def test_counts_equal_the_library(odd, word_bpe, hot):
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit)
                  for r in token_counts.token_counts(odd, word_bpe, limit=50, hot=max(hot, 1)).collect())
    want = Counter()
    for i, text in texts_of(odd):
        n = len(encoded(word_bpe, text))
        want[(i, len(text.encode()), n, n > 50)] += 1
    assert got == want


def test_round_trip_equals_the_library(odd, word_bpe):
    tok = Tokenizer.from_file(word_bpe)
    want = Counter()
    for i, text in texts_of(odd):
        ids = tok.encode(text, add_special_tokens=False).ids
        want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
              hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    out = bpe.round_trip(odd, word_bpe, with_texts=True).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == want
    for r in out:
        assert tok.decode(r.ids, skip_special_tokens=False) == r.decoded


def test_pair_index_on_runs_of_one_letter(word_bpe):
    table, index = Tokens(word_bpe), bpe.PairIndex(word_bpe)
    words = ["a" * n for n in range(1, 40)] + ["ab" * n for n in range(1, 20)] + [""]
    for word, ids in zip(words, index.encode(words)):
        assert ids.tolist() == ([t.id for t in table.tok.model.tokenize(word)] if word else [])


@pytest.mark.parametrize("n, bits", [(1, 4), (2, 4), (3, 12), (300, 9), (3000, 12), (5000, 17)])
def test_code_lengths_and_bits(n, bits):
    rng = np.random.default_rng(n)
    counts = (rng.pareto(1.0, n) * 10).astype(np.int64) + 1
    lengths = token_file.code_lengths(counts, bits)
    assert lengths.max() <= bits and (lengths > 0).all()
    if n > 1:
        assert sum(2.0 ** -lengths.astype(float)) == 1
    ids = rng.integers(0, n, 3000).astype(np.uint32)
    packed, marks = token_file.pack_bits(ids, token_file.canonical(lengths), lengths)
    one, two = token_file.Decoder(lengths).decode([packed, packed], [marks, marks], [3000, 3000])
    assert (one == ids).all() and (two == ids).all()


def test_code_is_optimal_under_its_limit():
    import itertools
    counts = np.array([1, 1, 2, 3, 5, 9])
    got = int((token_file.code_lengths(counts, 4) * counts).sum())
    best = min(sum(a * b for a, b in zip(ls, counts.tolist())) for ls in itertools.product(range(1, 5), repeat=6)
               if sum(2.0 ** -x for x in ls) <= 1)
    assert got == best


def test_token_files(spark, odd, byte_bpe):
    got = sorted(((r.start, r.n_tokens, r.ids_crc32, r.doc_id) for r in token_file.round_trip(odd, byte_bpe).collect()),
                 key=lambda r: r[0])
    want = Counter()
    for i, text in texts_of(odd):
        ids = encoded(byte_bpe, text) + [2]
        want[(i, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))] += 1
    assert Counter((i, n, c) for _, n, c, i in got) == want
    at, last = 0, None
    for start, n, _, i in got:
        assert start == at and (last is None or i >= last)
        at, last = at + n, i if i is not None else last


def test_empty_tables(empty, word_bpe, byte_bpe):
    assert packing.packed(empty, word_bpe).collect() == []
    assert token_counts.token_counts(empty, word_bpe).collect() == []
    assert bpe.round_trip(empty, word_bpe).collect() == []
    assert token_file.round_trip(empty, byte_bpe).collect() == []
