"""Vectorised words and hashes over Arrow string columns.

A column is cut into blocks of about two megabytes (a longer text is a block
of its own, never cut); in a block all words of all texts are found and
hashed together with numpy.  White space is ASCII, so UTF-8 bytes suffice.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
SMALL_BLOCK = 256 << 10     # for operators that hold tables of words beside a block
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=4)
def _byte_values(lower: bool) -> np.ndarray:
    codes = np.arange(256)
    if lower:
        codes = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
    return mix(codes.astype(np.uint64) + np.uint64(0x1234567))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = 2 * SMALL_BLOCK if n <= 2 * SMALL_BLOCK else max(n, BLOCK_BYTES + (1 << 18))
        up = np.full(n, _BASE)
        up[0] = 1
        down = np.full(n, _INVERSE)
        down[0] = 1
        _POWERS[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _POWERS[0], _POWERS[1]


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of values[start:end] for each span."""
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def string_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and each text's offsets (NULL: empty)."""
    col = col.fill_null("").cast(pa.large_string())
    _, offsets, data = col.buffers()
    ends = np.frombuffer(offsets, np.int64)[col.offset: col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0]: ends[-1]], ends - ends[0]


class Words:
    """The words of a block of texts: bytes ``raw[start[i]:end[i]]``; words of
    text d are ``first[d]:first[d+1]``."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets = raw, offsets
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = ~_IS_SPACE[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        self.start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        self.end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self, lower: bool) -> np.ndarray:
        return span_hash(_byte_values(lower)[self.raw], self.start, self.end)


def blocks(batch: pa.RecordBatch, column: str = "text",
           size: int = BLOCK_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of rows of about ``size`` bytes."""
    raw, offsets = string_buffer(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield slice(at, to), raw[offsets[at]: offsets[to]], offsets[at: to + 1] - offsets[at]
        at = to


def combine(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive values (length: len - n + 1)."""
    if len(word_hashes) < n:
        return np.zeros(0, np.uint64)
    m = len(word_hashes) - n + 1
    h = word_hashes[:m].copy()
    for i in range(1, n):
        h = h * _BASE + word_hashes[i: i + m]
    return mix(h)


def longs(a: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as Spark longs."""
    return pa.array(np.ascontiguousarray(a).view(np.int64))
