"""Shingle hashes of texts, for tasks that work with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import WORDS_PER_SHINGLE, remembered

_CACHED_WORDS = 100_000


class _WordHashes(dict):
    """64-bit hash of a word; remembers a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _chained(columns: list[np.ndarray]) -> np.ndarray:
    acc = np.full(len(columns[0]), len(columns), dtype=np.uint64)
    for c in columns:
        acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + c
    return _mixed(acc)


def shingle_sets(texts, k: int = WORDS_PER_SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (None as empty), A-Z lower-cased.

    ``bytes`` lower-cases A-Z only and splits at exactly 0x20 and 0x09 to 0x0D.
    """
    tokens = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    hashes = remembered("shingle words", _WordHashes)
    out = []
    for ws in tokens:
        h = np.fromiter(map(hashes.__getitem__, ws), dtype=np.uint64, count=len(ws))
        if len(h) == 0:
            out.append(h)
        elif len(h) < k:
            out.append(_chained([h[i:i + 1] for i in range(len(h))]))
        else:
            out.append(np.unique(_chained([h[i:len(h) - k + 1 + i] for i in range(k)])))
    return out


def odd_factors(n: int) -> np.ndarray:
    """Fixed odd 32-bit factors, one per minwise hash function."""
    return (_mixed(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def minwise(sets: list[np.ndarray], functions: int) -> np.ndarray:
    """Smallest value of each non-empty set under each hash function: (sets, functions) of uint32."""
    out = np.empty((len(sets), functions), dtype=np.uint32)
    factors = odd_factors(functions)
    first, block = 0, []
    filled = 0
    for i, s in enumerate(sets):  # blocks that stay in the processor's cache
        block.append((s >> np.uint64(32)).astype(np.uint32))
        filled += len(s)
        if filled >= 32_768 or i == len(sets) - 1:
            flat = np.concatenate(block)
            starts = np.concatenate(([0], np.cumsum([len(b) for b in block])[:-1]))
            for f, a in enumerate(factors):
                out[first:i + 1, f] = np.minimum.reduceat(flat * a, starts)
            first, block, filled = i + 1, [], 0
    return out
