"""Vectorised word kernels shared by the text operators.

A *word* is a maximal run of bytes outside ASCII white space (0x20, 0x09-0x0D),
which for UTF-8 equals a maximal run of characters outside that set.  All work is
done on the byte buffer of an Arrow string column, in blocks of a bounded number
of bytes, so memory does not depend on how many rows a batch holds.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
#: Bytes of text that are worked on at once (one document may exceed it).
BLOCK_BYTES = 1 << 21
#: Rows of a block at most.
BLOCK_ROWS = 1024
#: Longer words are hashed by xxh3 instead of the polynomial.
LONG_WORD = 256
_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MULT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_GRAM = (U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F))
_PIECE = 1 << 20
try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _libc = None
_tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply)."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    h *= U(0x9FB21C651E98DF25)
    return h ^ (h >> U(32))


def _lane(lane: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if lane not in _tables:
        m = _MULT[lane]
        values = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(lane * 7919 + 1)) | U(1)
        up = np.full(_PIECE, m, U)
        up[0] = 1
        down = np.full(_PIECE, pow(m, -1, 1 << 64), U)
        down[0] = 1
        _tables[lane] = values, np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
    return _tables[lane]


class Words(NamedTuple):
    """Words of a block of documents: byte spans in ``buf``, and ``first[i]:first[i + 1]`` are those of document i."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self, lane: int = 0) -> np.ndarray:
        return hash_spans(self.buf, self.start, self.end, lane)


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hash of each byte span; spans are in order and do not overlap."""
    values, up, down = _lane(lane)
    out = np.zeros(len(start), U)
    i = 0
    while i < len(start):
        lo = start[i]
        j = max(i + 1, int(np.searchsorted(end, lo + _PIECE, "right")))
        if end[j - 1] - lo <= _PIECE:
            part = values[buf[lo : end[j - 1]]]
            part *= up[: len(part)]
            total = np.zeros(len(part) + 1, U)
            np.cumsum(part, out=total[1:])
            s = start[i:j] - lo
            out[i:j] = (total[end[i:j] - lo] - total[s]) * down[s]
        i = j
    out = mix(out + (end - start).astype(U))
    for k in np.flatnonzero(end - start > LONG_WORD):
        out[k] = xxhash.xxh3_64_intdigest(buf[start[k] : end[k]].tobytes(), seed=lane + 1)
    return out


def split_words(buf: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the documents ``buf[offsets[i]:offsets[i + 1]]``."""
    n = len(buf)
    sep = _SEP[buf]
    head = np.ones(n + 1, bool)
    head[1:] = sep
    head[offsets] = True
    tail = np.ones(n + 1, bool)
    tail[:n] = sep
    tail[offsets] = True
    word = ~sep
    start = np.flatnonzero(word & head[:n])
    end = np.flatnonzero(word & tail[1:]) + 1
    return Words(buf, start, end, np.searchsorted(start, offsets), offsets)


def grams(h: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """Hash of every window of k consecutive entries, across documents too; see ``inside``."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    g = h[:n].copy()
    for j in range(1, k):
        g *= _GRAM[lane]
        g += h[j : j + n]
    return mix(g)


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """Whether the window of k words that starts at each word lies in one document."""
    n = int(first[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    counts = np.diff(first)
    last = np.repeat(first[1:], counts)
    return np.arange(n) + k <= last[:n]


def _release() -> None:
    """Gives memory that is free back to the system: workers live long, and what they hold counts against the executor."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of consecutive rows of about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for row in range(0, len(column), BLOCK_ROWS):  # casts copy, so not the whole batch at once
        part = pc.fill_null(column.slice(row, BLOCK_ROWS).cast(pa.large_string()), "")
        n = len(part)
        raw = part.buffers()
        offsets = np.frombuffer(raw[1], np.int64)[part.offset : part.offset + n + 1]
        data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
            yield row + i, row + j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j
    _release()


def word_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Words]]:
    for i, j, buf, offsets in blocks(column, limit):
        yield i, j, split_words(buf, offsets)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
