"""Words, word shingles and MinHash signatures, computed in Arrow batches."""

from __future__ import annotations

import hashlib
import re

import numpy as np

#: Words are runs of letters, digits and underscores in lower case.
_WORDS = re.compile(r"\w+")
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Words whose hashes a worker remembers; on overflow it starts anew.
CACHE = 300_000


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


class Shingler:
    """Sorted distinct 64-bit hashes of the runs of `size` words; a shorter text with words is one shingle."""

    def __init__(self, size: int = 5):
        self.size = size
        self.known: dict[str, int] = {}

    def _hash(self, word: str) -> int:
        h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(self.known) >= CACHE:
            self.known.clear()
        self.known[word] = h
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        found = words_of(text or "")
        get = self.known.get
        h = np.fromiter((get(w) or self._hash(w) for w in found), np.uint64, len(found))
        if not len(h):
            return h
        size = min(self.size, len(h))
        n = len(h) - size + 1
        out = h[:n].copy()
        for k in range(1, size):
            out = (out ^ (out >> np.uint64(29))) * _MIX + h[k : k + n]
        out = (out ^ (out >> np.uint64(32))) * _MIX
        return np.unique(out ^ (out >> np.uint64(31)))


def minhash(sets: list[np.ndarray], perms: int, seed: int = 1) -> np.ndarray:
    """One row of `perms` minima for each set; no set may be empty."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 2**63, perms, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, perms, np.uint64)
    out = np.empty((len(sets), perms), np.uint64)
    start = 0
    while start < len(sets):  # blocks that stay in the CPU's cache
        stop, size = start, 0
        while stop < len(sets) and (stop == start or size + len(sets[stop]) <= 30_000):
            size += len(sets[stop])
            stop += 1
        flat = np.concatenate(sets[start:stop])
        at = np.cumsum([0, *map(len, sets[start : stop - 1])])
        for k in range(perms):
            x = flat * a[k] + b[k]
            out[start:stop, k] = np.minimum.reduceat(x ^ (x >> np.uint64(33)), at)
        start = stop
    return out


def fingerprint(shingles: np.ndarray) -> bytes:
    """The same for the same set of shingles."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
