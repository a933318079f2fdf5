"""Words of a batch of texts as arrays of byte positions: numpy over Arrow buffers.

Nothing here is done word by word: a batch of texts is one byte array, words are spans
in it, and hashes of words and of windows of words come from prefix sums (Rabin-Karp,
modulo 2^64). Memory is about 40 bytes for each byte of a batch, so callers go through
``chunks``, which bounds the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; kept for the next call."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))])
                        for b in (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))))
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """Words of some texts. ``first[d]:first[d + 1]`` are the words of text ``d``."""

    data: np.ndarray    # uint8, all texts end to end
    offsets: np.ndarray  # where each text begins, and the end
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty, and the offsets of its values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray,
           size: int = CHUNK_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Whole texts in groups of about ``size`` bytes: (which texts, bytes, offsets)."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield slice(a, b), data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        a = b


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Runs of bytes that are no blanks, never across the end of a text."""
    inside = ~BLANK[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]  # where texts that are not empty begin
    begins[edges] = inside[edges]
    last = edges[edges > 0] - 1
    ends[last] = inside[last]
    start = np.flatnonzero(begins)
    return Words(data, offsets, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


def word_hashes(words: Words, lower: bool = False) -> np.ndarray:
    return span_hashes(LOWER[words.data] if lower else words.data, words.start, words.end)


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every window of ``size`` words within one text.

    The rolling form of Rabin-Karp: one prefix sum over all words, one difference a window.
    """
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = powers(len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up, out=sums[1:])
    room = np.repeat(first[1:], np.diff(first))[:n]  # the end of each word's text
    at = np.flatnonzero(np.arange(n) + size <= room)
    return at, mix((sums[at + size] - sums[at]) * down[at])


def covered(at: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of ``at``."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, at, 1)
    np.subtract.at(steps, at + size, 1)
    return np.cumsum(steps[:-1]) > 0


def sums_by_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of ``values`` between neighbouring offsets; empty ranges give 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
