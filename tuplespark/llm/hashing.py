"""Vectorised token hashes of texts, shared by the shingle operators."""

from __future__ import annotations

import numpy as np

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
CHUNK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    out[1:] = U(base)
    return np.multiply.accumulate(out)


_POW = _powers(_BASE, 4096)
_INV = _powers(pow(_BASE, -1, 1 << 64), 4096)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _hash_chunk(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    word = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    # Position inside the word, so that powers stay small tables; words over 4096 bytes wrap round with another factor.
    at = np.arange(len(b)) - np.repeat(start, np.diff(np.append(start, len(b)))) if start[0] == 0 else \
        np.arange(len(b)) - np.concatenate([np.zeros(start[0], np.int64), np.repeat(start, np.diff(np.append(start, len(b))))])
    term = np.where(word, _BYTE[b] * _POW[at & 4095], U(0))
    far = at >> 12
    if far.any():
        term = term * (U(2) * far.astype(np.uint64) + U(1))
    return mix(np.add.reduceat(term, start) + (end - start).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hash of each word (runs of non-space bytes, A-Z lower-cased)."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    if len(raw) <= CHUNK:
        return _hash_chunk(raw)
    parts, at = [], 0
    while at < len(raw):
        end = min(at + CHUNK, len(raw))
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        parts.append(_hash_chunk(raw[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``len(words) - k + 1`` windows of k words; a shorter,
    non-empty sequence is one shingle."""
    n = len(words)
    if n == 0:
        return words
    if n < k:
        out = U(n)
        with np.errstate(over="ignore"):
            for w in words:
                out = mix(np.array([out * U(0xD6E8FEB86659FD93) + w]))[0]
        return np.array([out], np.uint64)
    acc = np.full(n - k + 1, U(k) << U(32), np.uint64)
    for j in range(k):
        acc = acc * U(0xD6E8FEB86659FD93) + words[j:n - k + 1 + j]
        acc ^= acc >> U(29)
    return mix(acc)
