"""Words and shingles of many texts at once, as numpy arrays over one byte buffer.

A word is a run of bytes other than space and 0x09-0x0D, so the functions work on UTF-8
directly. Everything here is called inside Spark tasks on Arrow batches and holds one chunk
of texts (about a megabyte, or one long text) at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = _U(0xD1342543DE82EF95)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False


def _byte_values(fold: bool) -> np.ndarray:
    values = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=np.uint64)
    if fold:
        values[65:91] = values[97:123]
    return values


_VALUES = {fold: _byte_values(fold) for fold in (False, True)}


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers whose outputs look uniform."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    forward, backward = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 2**64), np.uint64)
    forward[0] = backward[0] = 1
    return np.cumprod(forward, dtype=np.uint64), np.cumprod(backward, dtype=np.uint64)


class Chunk(NamedTuple):
    """Rows ``start`` to ``stop`` of a column: their bytes, and where each text begins (with the end)."""

    start: int
    stop: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Byte range and document of each word, and the first word of each document (with the end)."""

    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Consecutive rows of a string column in pieces of about ``limit`` bytes; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(n, max(stop, start + 1))
        yield Chunk(start, stop, data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start])
        start = stop


def words(chunk: Chunk) -> Words:
    inside = _IS_WORD[chunk.data]
    before = np.empty_like(inside)
    before[1:], before[:1] = inside[:-1], False
    after = np.empty_like(inside)
    after[:-1], after[-1:] = inside[1:], False
    size = len(chunk.data)
    edges = chunk.offsets[:-1]
    before[edges[edges < size]] = False
    edges = chunk.offsets[1:]
    after[edges[edges > 0] - 1] = False
    begin = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(begin, end, np.searchsorted(begin, chunk.offsets))


def word_hashes(chunk: Chunk, found: Words, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word; with ``fold`` A-Z count as a-z."""
    size = len(chunk.data)
    forward, backward = _powers(1 << max(20, size.bit_length()))
    totals = np.zeros(size + 1, np.uint64)
    np.cumsum(_VALUES[fold][chunk.data] * forward[:size], out=totals[1:])
    sums = (totals[found.end] - totals[found.begin]) * backward[found.begin]
    return mix(sums + (found.end - found.begin).astype(np.uint64))


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, and the first run of each document (with the end).

    A document with fewer words has one run, its whole sequence; one without words has none.
    """
    counts = np.diff(first)
    runs = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at = np.concatenate(([0], np.cumsum(runs)))
    word = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], runs)
    left = np.repeat(first[1:], runs) - word
    padded = np.concatenate((hashes, np.zeros(width, np.uint64)))
    total = np.minimum(left, width).astype(np.uint64)
    for i in range(width):
        total *= _STEP
        total += np.where(left > i, padded[word + i], _U(0))
    return mix(total), at


def text_batches(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, Chunk]]:
    """Each chunk with the rows it covers."""
    for batch in batches:
        for chunk in chunks(batch.column(text)):
            yield batch.slice(chunk.start, chunk.stop - chunk.start), chunk
