"""Hashes of runs of words."""

from __future__ import annotations

import numpy as np
import xxhash

from tracelab.llm.common import cache

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Words whose hashes a worker keeps at hand.
KNOWN = 100_000


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _hashes(words: list[bytes], operator: str) -> np.ndarray:
    known = cache(operator)
    if len(known) > KNOWN:
        known.clear()
    for x in [x for x in set(words) if x not in known]:
        known[x] = xxhash.xxh64_intdigest(x)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


class Rolling:
    """Hashes of all runs of n words of a text, equal for equal runs, from one prefix sum. operator names the cache of words."""

    def __init__(self, words: list[bytes], operator: str):
        self.n = len(words)
        self.powers = _powers(_BASE, self.n + 1)
        sums = np.zeros(self.n + 1, np.uint64)
        if self.n:
            np.cumsum(_hashes(words, operator) * _powers(_BACK, self.n), out=sums[1:])
        self.sums = sums

    def runs(self, n: int) -> np.ndarray:
        h = (self.sums[n:] - self.sums[:-n]) * self.powers[: self.n - n + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))
