"""Words and word n-grams of Arrow text batches as numpy arrays.

A word is a run of bytes outside 0x20 and 0x09-0x0D, which UTF-8 uses for white space only. Words and n-grams are
compared by 64-bit hashes, so two different ones are taken for equal with a chance of 5e-20 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SLICE_BYTES = 1 << 19

_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over the whole word."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, SLICE_BYTES + 1)
        known = np.full(size, base, np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = known
    return known[:n]


class Words:
    """The words of some rows: bytes, [start, end) of each word, and ``first[i]:first[i + 1]`` of row i."""

    def __init__(self, texts: pa.Array, fold: bool = False):
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.data = LOWER[data] if fold else data
        inside = ~SPACE[self.data]
        cut = np.zeros(len(data) + 1, bool)
        cut[self.offsets] = True
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1] | cut[1:-1]
        end[:-1] &= ~inside[1:] | cut[1:-1]
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, self.offsets)

    def __len__(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word: a polynomial over its bytes, read off one running sum."""
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data + np.uint64(1)) * powers(BASE, len(self.data)), dtype=np.uint64, out=total[1:])
        h = (total[self.end] - total[self.start]) * powers(BASE_INVERSE, len(self.data) + 1)[self.start]
        return mix(h ^ (self.end - self.start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive entries."""
    size = max(0, len(hashes) - n + 1)
    h = np.zeros(size, np.uint64)
    for k in range(n):
        h = h * np.uint64(BASE) + hashes[k : k + size]
    return mix(h)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def shingles(words: Words, n: int) -> list[np.ndarray]:
    """Sorted distinct n-grams of every row; fewer than n words count as one, no words as none."""
    h, first = words.hashes(), words.first
    grams = ngrams(h, n)
    return [
        distinct(grams[a : b - n + 1]) if b - a >= n else ngrams(h[a:b], b - a) if b > a else h[:0] for a, b in zip(first[:-1], first[1:])
    ]


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about SLICE_BYTES of text each, so that arrays over bytes stay small."""
    if not batch.num_rows:
        return
    lengths = np.asarray(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    part = np.cumsum(lengths) // SLICE_BYTES
    edges = np.r_[0, np.flatnonzero(np.diff(part)) + 1, batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:]):
        yield batch.slice(a, b - a)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
