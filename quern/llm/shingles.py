"""Word shingles and MinHash values, vectorised with numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash


class _Words(dict):
    """word -> 64-bit hash; forgets everything beyond a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of k lower-cased, blank-separated words.

    A text of 1 to k-1 words is one shingle of all its words; null, empty and blank texts have none.
    """
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    n = len(h) - k + 1
    s = h[:n] * np.uint64(0x9E3779B97F4A7C15)
    for j in range(1, k):
        s ^= s >> np.uint64(29)
        s += h[j : n + j]
        s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(32)
    return np.unique(s)


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def coefficients(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def minhash(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    if len(x) <= 4096:
        return np.concatenate([(x[None, :] * a[i : i + 32, None] + b[i : i + 32, None]).min(1) for i in range(0, len(a), 32)])
    out = np.empty(len(a), np.uint32)
    buf = np.empty_like(x)
    for i in range(len(a)):
        np.multiply(x, a[i], out=buf)
        np.add(buf, b[i], out=buf)
        out[i] = buf.min()
    return out
