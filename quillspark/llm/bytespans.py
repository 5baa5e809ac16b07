"""Words and lines of many texts at once: numpy over Arrow's UTF-8 buffers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

STEP_BYTES = 500_000
ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(ODD, -1, 1 << 64)


@lru_cache(1)
def _trimmer():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return lambda keep: 0


def trim() -> None:
    """Gives freed memory back to the system: Python workers live on between tasks and share an executor's memory with the JVM."""
    pa.default_memory_pool().release_unused()
    _trimmer()(0)


def steps_of(column: pa.Array, size: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of rows of about size bytes each, with their bytes and offsets. A longer text is a range of its own."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j
    trim()


def word_spans(gap: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text number of every run of bytes that are no gap; runs end with their text."""
    first = at[:-1][np.diff(at) > 0]
    before = np.ones(len(gap), dtype=bool)
    before[1:] = gap[:-1]
    before[first] = True
    after = np.ones(len(gap), dtype=bool)
    after[:-1] = gap[1:]
    after[first[1:] - 1] = True
    begin = np.flatnonzero(~gap & before)
    return begin, np.flatnonzero(~gap & after) + 1, np.searchsorted(at, begin, side="right") - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: a polynomial modulo 2**64, from running sums, then mixed with the span's length."""
    n = len(raw)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(ODD, n), dtype=np.uint64)])
    out = (sums[end] - sums[begin]) * _powers(_INVERSE, n + 1)[begin]
    return mixed(out + (end - begin).astype(np.uint64) * np.uint64(ODD))
