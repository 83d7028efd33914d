"""Vectorised words and their hashes, over Arrow batches of texts.

A word is a run of bytes other than space and the five control characters
0x09-0x0D, in the UTF-8 form of the text. All of them are ASCII, so the words
are those of the pattern ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes hashed at once; a longer single word makes its own longer run.
_RUN = 1 << 19


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread 64-bit values: every output bit depends on every input bit."""
    h = h + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """The two power tables, made once in a worker and grown when a word is longer."""

    up = powers(_BASE, 1)
    down = powers(_BASE_INVERSE, 1)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = powers(_BASE, n), powers(_BASE_INVERSE, n)
        return cls.up, cls.down


@dataclass
class Words:
    """The words of some documents. ``first[d]:first[d + 1]`` are those of document ``d``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def find_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words with 64-bit hashes of their bytes; ``lower`` maps A-Z to a-z first."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    solid = ~_SPACE[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    if n:
        before[0], before[1:] = False, solid[:-1]
        after[-1], after[:-1] = False, solid[1:]
    start = np.flatnonzero(solid & (edge[:-1] | ~before))
    end = np.flatnonzero(solid & (edge[1:] | ~after)) + 1
    hashes = run_hash(_LOWER[data] if lower else data, start, end)
    return Words(data, offsets, start, end, hashes, np.searchsorted(start, offsets))


def run_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches ``values[start:end]``, which follow one another and don't overlap."""
    hashes = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _RUN, "right")))
        a, b = start[i], end[j - 1]
        up, down = _Powers.upto(max(_RUN, int(b - a)) + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum((values[a:b].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=total[1:])
        hashes[i:j] = (total[end[i:j] - a] - total[start[i:j] - a]) * down[start[i:j] - a]
        i = j
    return mix(hashes ^ (end - start).astype(np.uint64))


def slices(texts: pa.Array | pa.ChunkedArray, size: int = 1 << 22) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column into runs of whole documents of about ``size`` bytes: (from row, to row, bytes, offsets)."""
    data, offsets = text_bytes(texts)
    i, rows = 0, len(offsets) - 1
    while i < rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def gram_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` word hashes; the caller keeps those inside one document."""
    count = max(0, len(hashes) - n + 1)
    total = np.zeros(count, np.uint64)
    for j in range(n):
        total *= _BASE
        total += hashes[j : j + count]
    return mix(total, n)


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """Word positions at which a run of ``n`` words lies inside one document."""
    sizes = np.diff(first)
    runs = np.maximum(sizes - n + 1, 0)
    total = int(runs.sum())
    skip = np.repeat(first[:-1] - (np.cumsum(runs) - runs), runs)
    return np.arange(total) + skip


def range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs ``values[start:end]``, which may overlap."""
    if not len(start):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(values) + 1, np.uint64)
    up, down = _Powers.upto(len(values) + 1)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] ^ (end - start).astype(np.uint64))
