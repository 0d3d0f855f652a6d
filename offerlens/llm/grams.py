"""Words and word n-grams of UTF-8 text in numpy, shared by the operators on shingles.

A word is a longest run of characters other than space and U+0009 to U+000D, exactly what `bytes.split()` gives.
"""

from __future__ import annotations

import hashlib

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.frombuffer(hashlib.shake_256(b"byte values").digest(256 * 8), np.uint64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least `size` of each."""
    global _powers, _inverses
    if len(_powers) < size:
        size = 1 << (size - 1).bit_length()
        tables = []
        for factor in (_BASE, _INVERSE):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers, _inverses = tables
    return _powers, _inverses


def mixed(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def normalised(text: bytes) -> tuple[bytes, int]:
    """The words joined by single spaces, and their number."""
    words = text.split()
    return b" ".join(words), len(words)


def gram_hashes(joined: bytes, n_words: int, size: int) -> np.ndarray:
    """64-bit hash of every run of `size` words, in order; fewer words form one run, no word none."""
    if not n_words:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(joined, np.uint8)
    powers, inverses = _power_tables(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers[: len(data)], out=prefix[1:])
    gaps = np.flatnonzero(data == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(data)]))
    if n_words > size:
        starts, ends = starts[: n_words - size + 1], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    sums = (prefix[ends] - prefix[starts]) * inverses[starts]
    return mixed(sums ^ mixed((ends - starts).astype(np.uint64)))


def gram_set(text: bytes, size: int) -> np.ndarray:
    """The distinct n-gram hashes of a text, sorted."""
    return np.unique(gram_hashes(*normalised(text), size))
