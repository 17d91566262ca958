"""Word and word-sequence hashes, inside tasks, with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Upper case A-Z to lower case, all other bytes unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: LOWER, and every ASCII byte that is neither a letter nor a digit becomes a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
KNOWN_WORDS = 400_000
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class WordHashes(dict):
    """64-bit hashes of words (bytes); remembers a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < KNOWN_WORDS:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of BASE and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        m = max(2 * n, 1 << 15)
        base, inverse = np.full(m, BASE, np.uint64), np.full(m, INVERSE, np.uint64)
        base[0] = inverse[0] = 1
        _powers = (np.cumprod(base), np.cumprod(inverse))
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words, from the words' hashes: equal runs have equal hashes."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    up, down = powers(len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * down, out=total[1:])
    return mix((total[n:] - total[:m]) * up[:m] + np.uint64(n))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` values."""
    n, have = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    while have * 2 <= w:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[w - have : w - have + n])


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """All ``n``-word shingles of a document; with fewer words the whole sequence is the one shingle."""
    return grams(h, min(n, len(h))) if len(h) else np.empty(0, np.uint64)


def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    """The distinct shingles, sorted."""
    return np.unique(shingles(h, n))
