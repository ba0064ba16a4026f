"""Word and shingle hashes of whole Arrow string columns, in numpy.

A word's hash is a polynomial over random byte values modulo 2**64, read off a running sum, then mixed; a shingle's hash
combines the mixed hashes of its words. Everything works on flat arrays over many texts: no Python loop per word.
"""

from __future__ import annotations

from functools import cache

import numpy as np

U = np.uint64
#: Bytes whose words are hashed together; longer runs of text are cut between words.
SEGMENT = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@cache
def seeds(tag: int, n: int) -> np.ndarray:
    """n odd 64-bit values, the same in every process."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(tag)) | U(1)


@cache
def byte_values(fold_case: bool) -> np.ndarray:
    values = seeds(11, 256).copy()
    if fold_case:
        values[65:91] = values[97:123]
    return values


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SEGMENT + 4096)
        p = 0x5851F42D4C957F2D
        for base in (p, pow(p, -1, 1 << 64)):
            step = np.full(size, base, U)
            step[0] = 1
            _POWERS.append(np.multiply.accumulate(step))
        _POWERS[:] = _POWERS[-2:]
    return _POWERS[0][:n], _POWERS[1][:n]


@cache
def separators() -> np.ndarray:
    """Bytes between words: space and 0x09 to 0x0D."""
    sep = np.zeros(256, bool)
    sep[[0x20, *range(0x09, 0x0E)]] = True
    return sep


class Words:
    """The words of many units (texts or paragraphs) that lie side by side in one buffer.

    start and end are byte positions, hash the words' mixed hashes, first the index of each unit's first word (n + 1).
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, fold_case: bool = True):
        """bounds: n + 1 increasing positions; unit i is data[bounds[i]:bounds[i + 1]]."""
        lo, hi = int(bounds[0]), int(bounds[-1])
        inside = ~separators()[data[lo:hi]]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        edges = bounds[(bounds > lo) & (bounds < hi)] - lo
        fresh = inside & ~before
        fresh[edges] = inside[edges]
        self.start = np.flatnonzero(fresh) + lo
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[edges - 1] = inside[edges - 1]
        self.end = np.flatnonzero(last) + lo + 1
        self.first = np.searchsorted(self.start, bounds)
        self.hash = np.empty(len(self.start), U)
        values = byte_values(fold_case)
        done, n = 0, len(self.start)
        while done < n:
            base = int(self.start[done])
            stop = max(done + 1, int(np.searchsorted(self.end, base + SEGMENT, side="right")))
            top = int(self.end[stop - 1])
            up, down = powers(top - base)
            run = np.zeros(top - base + 1, U)
            np.cumsum(values[data[base:top]] * up, out=run[1:])
            a, b = self.start[done:stop] - base, self.end[done:stop] - base
            self.hash[done:stop] = mix((run[b] - run[a]) * down[a] + U(0x632BE59BD9B4E019) * (b - a).astype(U))
            done = stop

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of k (at most 32) consecutive words, unit by unit and sorted within each, and where each unit's begin (n + 1).

    A unit of fewer than k words, but not none, has its whole word sequence as its one shingle.
    """
    h, first, counts = words.hash, words.first, words.counts()
    by = seeds(23, 64)
    total = np.zeros(len(h), U)
    for j in range(k):
        total[: max(0, len(h) - j)] += h[j:] * by[j]
    keep = np.ones(len(h), bool)
    for j in range(1, k):
        at = first[1:] - j
        keep[at[at >= first[:-1]]] = False
    for u in np.flatnonzero((counts > 0) & (counts < k)):
        a, n = first[u], counts[u]
        total[a : a + 1] = (h[a : a + n] * by[32 : 32 + n]).sum(dtype=U) + seeds(29, 64)[n : n + 1]
        keep[a] = True
    flat = mix(total[keep])
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    for a, b in zip(starts[sizes > 1].tolist(), ends[sizes > 1].tolist(), strict=True):
        flat[a:b].sort()
    fresh = np.ones(len(flat), bool)
    fresh[1:] = flat[1:] != flat[:-1]
    fresh[starts[sizes > 0]] = True
    kept = np.r_[0, np.cumsum(fresh)]
    return flat[fresh], np.r_[kept[starts], kept[-1]] if len(starts) else np.zeros(1, np.int64)


def per_unit(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of values by unit."""
    run = np.zeros(len(values) + 1, U)
    np.cumsum(values, out=run[1:])
    return run[first[1:]] - run[first[:-1]]


def set_keys(flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each unit's set of hashes; equal sets have equal keys."""
    return per_unit(mix(flat ^ U(0xA24BAED4963EE407)), first).view(np.int64), per_unit(mix(flat + U(0x9FB21C651E98DF25)), first).view(np.int64)


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of several runs start..start+size, one after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)
