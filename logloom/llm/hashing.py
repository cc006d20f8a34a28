"""Stable 64-bit hashes of words and word n-grams of whole texts, in numpy."""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[[9, 10, 11, 12, 13, 32]] = 0
_BASE = np.uint64(int(_RNG.integers(1, 2**62)) * 4 + 1)
_MANY = _RNG.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)
_KEPT_POWERS = 1 << 16


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 4096), _BASE, np.uint64)
        more[0] = 1
        more = np.cumprod(more, dtype=np.uint64)
        if n > _KEPT_POWERS:  # of one very long word: not kept
            return more
        _powers = more
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """One hash for each word (run without ASCII white space), in order."""
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    values = _BYTE[data]
    inside = values != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    values = values[starts[0] :] * _power(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, starts - starts[0]))


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of runs of `width` words of the text, A-Z in lower case; a shorter text is one shingle."""
    words = word_hashes(text.lower())
    if not len(words):
        return words
    width = min(width, len(words))
    size = len(words) - width + 1
    grams = words[:size] * _MANY[0]
    for i in range(1, width):
        grams = grams + words[i : i + size] * _MANY[i]
    return np.unique(mix(grams + np.uint64(width)))


def multipliers(n: int, skip: int = 0) -> np.ndarray:
    return _MANY[16 + skip : 16 + skip + n]
