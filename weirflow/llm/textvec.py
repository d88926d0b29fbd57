"""Whole-batch text primitives on numpy arrays: words, hashes, shingles, lookups.

A text column arrives as Arrow; its UTF-8 bytes are one contiguous buffer, so
word boundaries and word hashes of all its texts come from a few array
operations rather than a loop over words. Texts are taken in slices of about
``CHUNK`` bytes, which bounds memory at some 60 bytes per byte of a slice (a
single text longer than that is a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

pa.set_memory_pool(pa.system_memory_pool())  # gives freed buffers back to the system

CHUNK = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64))
_SYMBOL_FOLDED = _SYMBOL[LOWER]

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offs, kind, count=n + 1, offset=arr.offset * kind().itemsize)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets.astype(np.int64) - int(offsets[0])


def slices(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` of every text and, per text, where its words begin.

    Text i has the hashes ``h[at[i]:at[i + 1]]``. With ``fold``, A-Z count as a-z.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] |= inside[first]
    last = first[1:] - 1
    ends[last] |= inside[last]
    b, e = np.flatnonzero(begins), np.flatnonzero(ends)
    power, inverse = _power_tables(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_SYMBOL_FOLDED if fold else _SYMBOL)[data] * power[:n], out=sums[1:])
    h = (sums[e + 1] - sums[b]) * inverse[b]
    return mix(h ^ (e - b + 1).astype(np.uint64)), np.searchsorted(b, offsets).astype(np.int64)


def text_words(arr: pa.Array, fold: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Over slices of a string array: (first row, end row, word hashes, begins within the slice)."""
    data, offsets = utf8(arr)
    for i, j in slices(offsets):
        part = offsets[i : j + 1]
        h, at = word_hashes(data[part[0] : part[-1]], part - part[0], fold)
        yield i, j, h, at


def ngram_hashes(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one text, and where each text's begin."""
    total = len(words)
    counts = np.maximum(np.diff(at) - (n - 1), 0)
    begins = np.concatenate([[0], np.cumsum(counts)])
    if total < n or begins[-1] == 0:
        return np.zeros(0, np.uint64), begins
    grams = words[: total - n + 1].copy()
    for k in range(1, n):
        grams *= np.uint64(_BASE)
        grams += words[k : total - n + 1 + k]
    starts = np.repeat(at[:-1] - begins[:-1], counts) + np.arange(begins[-1])
    return mix(grams[starts]), begins


def shingle_sets(arr: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its n-word shingles.

    A text with fewer words has its whole word sequence as the one shingle; one
    without words has none.
    """
    for i, j, words, at in text_words(arr):
        grams, begins = ngram_hashes(words, at, n)
        for k in range(j - i):
            if begins[k + 1] > begins[k]:
                yield np.unique(grams[begins[k] : begins[k + 1]])
            elif at[k + 1] > at[k]:
                whole = int(at[k + 1] - at[k])
                for w in words[at[k] : at[k + 1]].tolist():
                    whole = (whole * _BASE ^ w) & _MASK
                yield np.array([whole], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


class HashIndex:
    """Open-addressing table from distinct unsigned 64-bit keys to their positions."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.ascontiguousarray(keys, dtype=np.uint64)
        n = len(self.keys)
        bits = max(4, int(np.ceil(np.log2(max(n, 1) * 2 + 1))))
        self.mask = np.uint64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, np.int32)
        left = np.arange(n, dtype=np.int32)
        where = self._home(self.keys)
        while len(left):
            free = self.slots[where] < 0
            self.slots[where[free]] = left[free]
            lost = self.slots[where] != left
            left = left[lost]
            where = (where[lost] + 1) & int(self.mask)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(_BASE)) >> np.uint64(20) & self.mask).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where it is absent."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys) or not len(keys):
            return out
        left = np.arange(len(keys))
        where = self._home(keys)
        while len(left):
            got = self.slots[where]
            taken = got >= 0
            hit = taken & (self.keys[got] == keys[left])
            out[left[hit]] = got[hit]
            on = taken & ~hit
            left, where = left[on], (where[on] + 1) & int(self.mask)
        return out
