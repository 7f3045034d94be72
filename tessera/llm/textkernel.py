"""Vectorised word and n-gram hashing over Arrow string columns.

A document is a run of bytes in one buffer. Words are maximal runs without the bytes 0x20 and
0x09-0x0D, which never occur inside a multi-byte UTF-8 character, so byte positions are safe.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
CHUNK_BYTES = 1 << 19
LAST = np.iinfo(np.int64).max

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _run(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least; only those of a slab of usual size are kept."""
    size = 2 * CHUNK_BYTES
    if n > size:  # a word or line longer than any slab
        return _run(BASE, n), _run(INVERSE, n)
    if len(_powers[0]) < n:
        _powers[:] = [_run(BASE, size), _run(INVERSE, size)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, equal wherever the bytes stand.

    Spans come in order and do not overlap, so a long text is hashed slab by slab and needs no more
    memory than a slab, or than its longest span.
    """
    if len(data) <= CHUNK_BYTES or not len(start):
        return _span_hashes(data, start, end)
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + CHUNK_BYTES, side="right")))
        low, high = start[i], end[j - 1]
        out[i:j] = _span_hashes(data[low:high], start[i:j] - low, end[i:j] - low)
        i = j
    return out


def _span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial from prefix sums, then mixed."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    terms = total[1:]
    terms += data
    terms += U(1)
    terms *= up[: len(data)]
    np.cumsum(terms, out=terms)
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U))


@dataclass
class Words:
    """Words of several documents: byte bounds, and per document the range of its words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # len(documents) + 1

    def hashes(self, lower: bool = False) -> np.ndarray:
        data = self.data
        if lower:
            data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
        return span_hashes(data, self.start, self.end)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64))
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    filled = offsets[1:] > offsets[:-1]
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    before[offsets[:-1][filled]] = False
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    after[offsets[1:][filled] - 1] = False
    start = np.flatnonzero(solid & ~before)
    end = np.flatnonzero(solid & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def chunks(text: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) with about `limit` bytes; null text counts as empty."""
    for part in text.chunks if isinstance(text, pa.ChunkedArray) else [text]:
        yield from _chunks(part, limit)


def _chunks(part: pa.Array, limit: int):
    part = pc.fill_null(part.cast(pa.large_string()), "")
    n = len(part)
    if not n:
        return
    buffers = part.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, part.offset * 8).copy()
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def each_words(text: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, Words]]:
    """(row of the first document, its words) over all rows, in order."""
    base = 0
    for part in text.chunks if isinstance(text, pa.ChunkedArray) else [text]:
        for i, j, data, offsets in _chunks(part, limit):
            yield base + i, find_words(data, offsets)
        base += len(part)


def grams(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of each k consecutive values of h; len(h) - k + 1 of them, document borders not yet heeded."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    factor = U(pow(0xD6E8FEB86659FD93 + 2 * seed | 1, 1, 1 << 64))
    out = np.zeros(n, U)
    for j in range(k):
        out *= factor
        out += h[j : j + n]
    return mix(out + U(seed * 0x9E3779B9 & 0xFFFFFFFFFFFFFFFF))


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """Which positions of grams(h, k) lie within one document."""
    n = int(first[-1])
    end = np.repeat(first[1:], np.diff(first))
    return np.arange(max(0, n - k + 1)) + k <= end[: max(0, n - k + 1)]
