"""Vectorised work on the UTF-8 bytes of Arrow string columns.

A batch's texts lie end to end in one buffer, so words, sentences and n-grams are found with a few numpy
passes over bytes and no Python string is made. Work goes in row-aligned pieces of about PIECE bytes, which
bounds the temporaries whatever the batch holds (a longer single text is a piece of its own).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: list[np.ndarray] = []

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: digits, letters and everything outside ASCII.
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[65:91] = True
WORD[128:] = True


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row starts (one more at the end); null rows are empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    if len(offsets) == 0:
        offsets = np.zeros(1, dtype=np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, starts) of consecutive pieces of a column."""
    raw, offsets = column_bytes(column)
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, to, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def spans(mask: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that no cut (a position, as a row's start) lies inside."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    ends = mask.copy()
    ends[:-1] &= ~mask[1:]
    inner = cuts[(cuts > 0) & (cuts < len(mask))]
    begins[inner] = mask[inner]
    ends[inner - 1] = mask[inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, m, np.uint64)])) for m in (_MULT, inverse)]
    return _powers[0], _powers[1]


def running(raw: np.ndarray) -> np.ndarray:
    """Prefix sums from which piece_hash takes the hash of any span."""
    up, _ = _power(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same wherever the span stands."""
    _, down = _power(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_hash(word: bytes) -> int:
    """The hash that span_hash gives these bytes."""
    raw = np.frombuffer(word, dtype=np.uint8)
    return int(span_hash(running(raw), np.zeros(1, np.int64), np.full(1, len(raw), np.int64))[0])


def row_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that each position lies in."""
    return np.searchsorted(offsets, positions, side="right") - 1


def sums_by_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n)


def release() -> None:
    """Gives memory that the task no longer uses back to the system: idle workers share the executor's with what runs next."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def task(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], at_end: Callable[[], None] | None = None) -> Callable:
    """f for mapInArrow, with release() at the end of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            if at_end is not None:
                at_end()
            release()

    return run
