"""Word and shingle hashing of whole texts, vectorised over the bytes of a batch.

Words are the runs outside ``[\\x20\\x09-\\x0D]`` after lower-casing A-Z. A word's hash is a polynomial over per-byte
random 64-bit values, so that all words of a batch come from one running sum; a shingle's hash mixes its words' hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from knotwork.llm.common import utf8_buffers

U = np.uint64
_RNG = np.random.default_rng(20240607)
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_VALUE[65:91] = _VALUE[97:123]
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 21)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of each text in order, and the text's index for each word."""
    raw, offs = utf8_buffers(texts)
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = _WORD[raw]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    start[inner] = word[inner]
    end[inner - 1] = word[inner - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end)
    up, down = _power(n)
    total = _VALUE[raw]
    total *= up[:n]
    np.cumsum(total, out=total)
    before = np.where(s > 0, total[s - 1], U(0))
    return mix((total[e] - before) * down[s]), np.searchsorted(offs, s, "right") - 1


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles of ``words`` words as sorted hashes, one text after the other, and where each text begins.

    A text with fewer words has its whole sequence as the only shingle; one without words has none.
    """
    h, doc = word_hashes(texts)
    count = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
    k = max(len(h) - words + 1, 0)
    x = np.zeros(k, np.uint64)
    for j in range(words):
        x = x * U(0xD6E8FEB86659FD93) + h[j : j + k]
    full = doc[:k] == doc[words - 1 : words - 1 + k]
    x, d = mix(x)[full], doc[:k][full]
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        first = np.concatenate(([0], np.cumsum(count)[:-1]))
        own = [int(first[i]) for i in short]
        y = np.array([_sequence(h[a : a + count[i]]) for a, i in zip(own, short, strict=True)], np.uint64)
        x, d = np.concatenate((x, y)), np.concatenate((d, short))
    order = np.lexsort((x, d))
    x, d = x[order], d[order]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
    x, d = x[keep], d[keep]
    return x, np.searchsorted(d, np.arange(len(texts) + 1))


def _sequence(h: np.ndarray) -> int:
    x = len(h)
    for v in h.tolist():
        x = (x * 0xD6E8FEB86659FD93 + v) % 2**64
    return int(mix(np.array([x ^ 0x5DEECE66D], np.uint64))[0])
