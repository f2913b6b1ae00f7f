"""Byte-level helpers for Arrow batches of texts: words, their hashes, and blocks of bounded size.

Everything here works on the UTF-8 bytes of many texts at once. Separators and
A-Z are ASCII, so bytes of longer characters never match them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once inside a task; one longer text makes a block of its own.
BLOCK_BYTES = 4 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes between words of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
IS_BLANK = np.zeros(256, dtype=bool)
IS_BLANK[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A published 64-bit finaliser; every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of rows) for runs of rows of about ``limit`` bytes; a null text is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = IS_BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the block, and per row the index of its first word (one more entry than rows)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~blank[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]  # a word never runs on into the next row
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial over the bytes, with its length, mixed."""
    if not len(start):
        return np.zeros(0, np.uint64)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_MULTIPLIER, len(data)), out=sums[1:])
    value = (sums[end] - sums[start]) * _powers(_INVERSE, len(data))[start]
    return mix(value ^ ((end - start).astype(np.uint64) << np.uint64(48)))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, BLOCK_BYTES), base, np.uint64)
        known[0] = 1
        np.cumprod(known, out=known)
        if n <= 4 * BLOCK_BYTES:
            _POWERS[base] = known
    return known[:n]


def shingle_hashes(hashes: np.ndarray, first_word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row's word windows, sorted within the row, and the rows' bounds in them.

    A row with fewer words than ``size`` has its whole sequence as one shingle; a row without words has none.
    """
    n_words = np.diff(first_word)
    counts = np.where(n_words >= size, n_words - size + 1, (n_words > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(len(counts)), counts)
    if not len(row):
        return np.zeros(0, np.uint64), bounds
    at = np.arange(len(row)) - bounds[:-1][row] + first_word[:-1][row]
    last = first_word[1:][row]
    value = np.zeros(len(row), np.uint64)
    for k in range(size):
        there = at + k < last
        value = mix(value * np.uint64(_MULTIPLIER) + np.where(there, hashes[np.minimum(at + k, len(hashes) - 1)], np.uint64(k + 1)))
    for i in np.flatnonzero(counts > 1):
        value[bounds[i] : bounds[i + 1]].sort()
    new = np.ones(len(row), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(counts)))])
