"""Vectorised words and word fingerprints over Arrow string columns.

A word is a run of bytes outside space and \\t \\n \\v \\f \\r; A-Z count as a-z unless asked otherwise.
Everything works on the Arrow buffers of a whole batch, so no Python object is made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd pseudo-random 64-bit constants."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(np.array([seed], np.uint64))) | np.uint64(1)


IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_EXACT = constants(256, 11)
_EXACT[~IS_WORD] = 0
_LOWER = _EXACT.copy()
_LOWER[65:91] = _EXACT[97:123]
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n at least."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, CHUNK + 1)
        made = []
        for base in (_BASE, _BASE_INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            made.append(p)
        _powers[:] = made
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its values; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n, at = len(column), column.offset
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word (n + 1 entries)."""
    inside = IS_WORD[data]
    begins, finishes = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        finishes[:-1] &= ~inside[1:]
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[first] = inside[first]
        last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        finishes[last] = inside[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit fingerprint of each word; equal words have equal fingerprints in any batch."""
    table, out, i, n = _LOWER if lower else _EXACT, np.empty(len(starts), np.uint64), 0, len(starts)
    while i < n:
        at = starts[i]
        j = max(int(np.searchsorted(ends, at + CHUNK, "right")), i + 1)
        length = int(ends[j - 1] - at)
        power, inverse = _tables(length)
        sums = np.empty(length + 1, np.uint64)
        sums[0] = 0
        np.cumsum(table[data[at : at + length]] * power[:length], out=sums[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        i = j
    return out


class Words:
    """Words of a batch of texts: starts, ends (bytes), first (index of each text's first word), prints."""

    def __init__(self, column: pa.Array, lower: bool = True):
        self.data, self.offsets = buffers(column)
        self.starts, self.ends, self.first = split(self.data, self.offsets)
        self.prints = fingerprints(self.data, self.starts, self.ends, lower)

    def __len__(self) -> int:
        return len(self.offsets) - 1


_GRAM = constants(64, 29)


def grams(prints: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of the k-word windows of a run of words; empty if there are fewer words."""
    n = len(prints) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += mix(prints[j : j + n] + _GRAM[j]) * _GRAM[j + 1]
    return mix(out)


def shingle_set(prints: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct k-word shingles of one text; a shorter text has its whole sequence as one."""
    n = len(prints)
    if n == 0:
        return prints
    if n < k:
        return grams(prints, n) ^ np.uint64(n)
    return np.unique(grams(prints, k))
