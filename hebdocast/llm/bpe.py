"""BPE encoding with a pair occurrence index, and decoding.

The distinct pre-tokens of a block of documents are laid out as one long list of symbols with links
to the neighbour on either side. An index maps every adjacent pair that has a merge to all positions
where it stands. Active merge ranks are then taken in ascending order: a rank's positions are merged
at once, and only the pairs next to them enter or leave the index. As pre-tokens don't touch, this
is the order in which each of them alone would be merged. Ids of documents are the ids of their
words, looked up; decoding looks every id up in the vocabulary and joins the pieces as the tokenizer
file says (by one space without a decoder).

Scale: one pass over the scan, no shuffle; a block holds at most ``BLOCK_BYTES`` of text beyond one
row, and tables kept between blocks are emptied at a fixed size.

Defined results: a null text is empty and has no ids; a null id is kept; every row gives one row,
repeated ones too; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import _KEPT, id_type, pick, worker_for
from .tokens import Tokens, tokens

BLOCK_BYTES = 24 << 20


class PairIndex:
    """Merges of a tokenizer file, applied to many pre-tokens at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.vocab, self.suffix = vocab, model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.left, self.right = left, right
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left << 32 | right
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 without a merge."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def encode(self, words: list[str]) -> list[np.ndarray]:
        """Ids of every pre-token, given in the byte alphabet."""
        vocab, suffix = self.vocab, self.suffix
        first = np.cumsum([0] + [len(w) for w in words])
        symbol = np.array([vocab[c] for w in words for c in w], np.int64)
        n = len(symbol)
        if not n:
            return [symbol] * len(words)
        ends = first[1:][np.diff(first) > 0] - 1
        if suffix:
            symbol[ends] = [vocab[w[-1] + suffix] for w in words if w]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends] = -1
        before[first[:-1][np.diff(first) > 0]] = -1

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Put the pairs that start at these positions into the index."""
            if not len(at):
                return
            rank = self.ranks(symbol[at], symbol[after[at]])
            keep = rank >= 0
            at, rank = at[keep], rank[keep]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            lists = np.split(at, cuts) if len(cuts) else [at] if len(at) else []
            for r, positions in zip(rank[np.concatenate([[0], cuts])].tolist() if len(at) else [], lists):
                if r in index:
                    index[r].append(positions)
                else:
                    index[r] = [positions]
                    heapq.heappush(active, r)

        enter(np.flatnonzero(after >= 0))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
            a, b = self.left[r], self.right[r]
            right = after[at]
            live = (symbol[at] == a) & (right >= 0)
            live &= symbol[right] == b  # a position out of date fails one of the tests
            at, right = at[live], right[live]
            if a == b and len(at) > 1:  # in a run of one symbol every second pair merges, from the left
                joined = np.concatenate([[False], right[:-1] == at[1:]])
                start = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
                even = (np.arange(len(at)) - start) % 2 == 0
                at, right = at[even], right[even]
            if not len(at):
                continue
            far = after[right]
            symbol[at] = self.made[r]
            symbol[right] = -1
            after[at] = far
            inner = far >= 0
            before[far[inner]] = at[inner]
            prior = before[at]
            enter(np.unique(np.concatenate([prior[prior >= 0], at[inner]])))
        kept = symbol >= 0
        total = np.concatenate([[0], np.cumsum(kept)])
        return np.split(symbol[kept], total[first[1:-1]])


class Codec:
    """Words of texts to ids, and ids to text, remembered by word up to a fixed number."""

    LIMIT = 350_000

    def __init__(self, path: str):
        self.table: Tokens = tokens(path)
        if self.table.kind != "word":
            raise ValueError("blocks of this codec are words: a tokenizer that drops white space is needed")
        self.index = PairIndex(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.piece = {i: s for s, i in spec["model"]["vocab"].items()}
        self.piece |= {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.glue = " " if spec["decoder"] is None else None
        self.known: dict[str, list[int]] = {}  # pre-token -> ids
        self.words: dict[bytes, tuple[int, bytes, bytes]] = {}

    def pretokens(self, word: bytes) -> list[str]:
        """Pre-tokens of a word; special strings stand for themselves."""
        text = word.decode("utf-8", "replace")
        plain = self.table.pretokens(text)
        if plain is not None:
            return plain
        tok, out = self.table.tok, []
        at = 0
        for m in [*self.table.specials.finditer(word), None]:
            part = word[at:m.start() if m else None].decode("utf-8", "replace")
            if part:
                out += [p for p, _ in tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(part))]
            if m:
                out.append(m[0].decode())
                at = m.end()
        return out

    def learn(self, words) -> None:
        """Encode the words that aren't known yet."""
        if len(self.words) > self.LIMIT:
            self.words.clear()
        if len(self.known) > self.LIMIT:
            self.known.clear()
        parts = {w: self.pretokens(w) for w in words if w not in self.words}
        fresh = [p for p in dict.fromkeys(p for ps in parts.values() for p in ps)
                 if p not in self.known and p not in self.special]
        self.known |= zip(fresh, (x.tolist() for x in self.index.encode(fresh)))
        for word, pieces in parts.items():
            ids = [i for p in pieces for i in ([self.special[p]] if p in self.special else self.known[p])]
            self.words[word] = (len(ids), "".join([f" {i}" for i in ids]).encode(),
                                self.decode(ids, lead=True))

    def decode(self, ids: list[int], lead: bool = False) -> bytes:
        """Text of ids; special ones are kept. With ``lead`` every piece has its separator in front,
        so that texts of words can be joined."""
        if self.glue is None:
            raise ValueError("this tokenizer file names a decoder")
        out = "".join([self.glue + self.piece[i] for i in ids])
        return (out if lead else out[len(self.glue):]).encode()


_CODECS: dict[str, Codec] = {}
_KEPT.append(_CODECS)


def codec(path: str) -> Codec:
    worker_for("tokens")
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def round_trip(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text",
               with_texts: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, and with ``with_texts`` also
    ``ids`` (array<int>) and ``decoded`` (string)."""

    def run(batches):
        coder = codec(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            at = 0
            while at < len(texts):
                block, size = [], 0
                while at < len(texts) and size < BLOCK_BYTES:
                    block.append(texts[at].as_py().split())
                    size += len(texts[at].as_py())
                    at += 1
                distinct: set[bytes] = set()
                distinct.update(*block)
                coder.learn(distinct)
                yield rows(batch.column(0).slice(at - len(block), len(block)), block, coder)

    def rows(keys, block, coder):
        n, ids_sha, text_sha, ids_out, text_out = [], [], [], [], []
        for words in block:
            found = list(map(coder.words.__getitem__, words))
            ids = b"".join([f[1] for f in found])[1:]
            text = b"".join([f[2] for f in found])[1:]
            n.append(sum([f[0] for f in found]))
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            text_sha.append(hashlib.sha256(text).hexdigest())
            if with_texts:
                ids_out.append(np.array(ids.split(), np.int32))
                text_out.append(text.decode())
        cols = [keys, pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_texts:
            cols += [pa.array(ids_out, pa.list_(pa.int32())), pa.array(text_out, pa.string())]
            names += ["ids", "decoded"]
        return pa.RecordBatch.from_arrays(cols, names)

    schema = (f"doc_id {id_type(docs, id_col)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
              + (", ids array<int>, decoded string" if with_texts else ""))
    return pick(docs, id_col, text_col).mapInArrow(run, schema)
