"""Word shingles as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash


def mix(h: np.ndarray, seed: int) -> np.ndarray:
    """A bijective 64-bit scramble (two xor-shift-multiply rounds); another one for each seed."""
    x = h.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def words_of(text: str) -> list[bytes]:
    """Words, A-Z lower-cased, in UTF-8. On bytes lower() and split() know A-Z and code points 20, 09 to 0D only."""
    return text.encode().lower().split()


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash for each word of the text. (Hashing a word costs less than looking it up.)"""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words_of(text))), np.uint64)


#: Odd multipliers of the words in a window, in order of position.
ODD = tuple(np.uint64((k * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64 | 1) for k in range(1, 33))


def window_hashes(h: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """For each start, a hash of the words at ``offsets`` from it, in order; none if the text is shorter."""
    n = len(h) - offsets[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, o in enumerate(offsets):
        out += h[o : o + n] * ODD[k]
    return mix(out, 31)


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of ``words`` words; a shorter text with a word is one shingle."""
    h = word_hashes(text)
    if not len(h):
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(h, tuple(range(min(words, len(h))))))
