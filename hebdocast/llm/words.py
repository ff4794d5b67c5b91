"""Hashes of words and of runs of words, for whole Arrow batches of texts at a time."""

from __future__ import annotations

import hashlib

import numpy as np

from .common import worker_for

BLOCK = 1 << 19  # bytes hashed at once; a longer text is a block of its own
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def multipliers(n: int, salt: str) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers that depend on ``salt`` alone."""
    raw = b"".join(hashlib.blake2b(f"{salt}{i}".encode(), digest_size=8).digest() for i in range(n))
    return np.frombuffer(raw, np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_FORWARD, _BACK = _powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16)


def _table(known: np.ndarray, base: int, n: int) -> np.ndarray:
    return known if n <= len(known) else _powers(base, n)


def word_hashes(raw: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of every word of a byte array that ends with white space."""
    global _FORWARD, _BACK
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(raw) and not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    if lower:
        raw = _LOWER[raw]
    if len(raw) > len(_FORWARD) and len(raw) <= 2 * BLOCK:
        _FORWARD, _BACK = _powers(_BASE, 2 * BLOCK), _powers(_INVERSE, 2 * BLOCK)
    forward, back = _table(_FORWARD, _BASE, len(raw)), _table(_BACK, _INVERSE, len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * forward[:len(raw)], out=total[1:])
    h = mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > 64):  # a sum is too weak a hash for long runs
        digest = hashlib.blake2b(raw[starts[i]:ends[i]].tobytes(), digest_size=8).digest()
        h[i] = np.frombuffer(digest, np.uint64)[0]
    return starts, ends, h


def blocks(texts):
    """Rows of an Arrow binary array in blocks of about ``BLOCK`` bytes: ``(first row, bytes with a
    space behind each text, first byte of each text and the end)``."""
    at, n = 0, len(texts)
    while at < n:
        first, parts, size = at, [], 0
        while at < n and (size < BLOCK or not parts):
            part = texts[at].as_py() or b""
            parts.append(part)
            size += len(part) + 1
            at += 1
        joined = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
        yield first, joined, np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])


def text_words(texts, lower: bool):
    """For every row of an Arrow binary array: ``(row, bytes, starts, ends, hashes)`` of its words."""
    worker_for("words")
    for first, raw, bounds in blocks(texts):
        starts, ends, h = word_hashes(raw, lower)
        cut = np.searchsorted(starts, bounds)
        for k in range(len(bounds) - 1):
            s = slice(cut[k], cut[k + 1])
            yield first + k, raw, starts[s], ends[s], h[s]


def runs(h: np.ndarray, size: int, factors: np.ndarray) -> np.ndarray:
    """64-bit hash of every run of ``size`` words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n] * factors[0]
    for j in range(1, size):
        out += h[j:j + n] * factors[j]
    return mix(out)
