"""Suffix arrays by the difference-cover algorithm, in numpy, to a bounded depth."""

from __future__ import annotations

import numpy as np


def _ranks(key: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks from 1 of the keys, and how many there are."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.empty(len(s), np.int64)
    new[:1] = 1
    new[1:] = s[1:] != s[:-1]
    out = np.empty(len(s), np.int64)
    np.cumsum(new, out=new)
    out[order] = new
    return out, int(new[-1]) if len(new) else 0


def suffix_array(s: np.ndarray, depth: int | None = None, covered: int = 1) -> np.ndarray:
    """Order of the suffixes of s (ints over 0); with depth, suffixes that agree on so many symbols stay in any order.

    Sample the positions that aren't divisible by three, sort their triples, recurse on the names
    until they differ or reach the depth, sort the rest by one symbol and a sampled rank, merge.
    Composite keys take 63 bits, so s may have 2^21 - 4 symbols and values below 2^21.
    """
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    base = np.int64(max(int(s.max()), n) + 2)
    if base > 2**21:
        raise ValueError("the text is too long for one call")
    t = np.zeros(n + 3, np.int64)
    t[:n] = s
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    names, kinds = _ranks((t[sample] * base + t[sample + 1]) * base + t[np.minimum(sample + 2, n + 2)])
    if kinds < len(sample) and not (depth and 3 * covered >= depth):
        inner = suffix_array(names, depth, 3 * covered)
        names = np.empty(len(sample), np.int64)
        names[inner] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = names
    order = sample[np.argsort(names, kind="stable")]
    order = order[order < n]
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(t[rest] * base + rank[rest + 1], kind="stable")]
    m1, m2 = order[order % 3 == 1], order[order % 3 == 2]
    less = np.searchsorted(t[m1] * base + rank[m1 + 1], t[rest] * base + rank[rest + 1], "left")
    less += np.searchsorted((t[m2] * base + t[m2 + 1]) * base + rank[np.minimum(m2 + 2, n + 3)], (t[rest] * base + t[rest + 1]) * base + rank[np.minimum(rest + 2, n + 3)], "left")
    less = np.maximum.accumulate(less)
    out = np.empty(n, np.int64)
    at = np.arange(len(rest)) + less
    taken = np.zeros(n, bool)
    taken[at] = True
    out[at] = rest
    out[~taken] = order
    return out
