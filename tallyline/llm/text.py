"""Whole Arrow text columns as byte arrays: words, shingles and their 64-bit hashes in numpy.

Rows are taken in slices of a few MB, so the arrays stay small whatever the batch; a row is never cut.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
POWERS = SLICE + 2  # powers that are kept, as many as a slice of any operator needs
ROWS = 4096  # rows whose bytes are copied out of a batch at once
U64 = np.uint64
# Fixed odd multipliers and seeds of the hashes.
BASE = 0x9E3779B97F4A7C15
STEPS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    x = (x ^ (x >> U64(30))) * U64(STEPS[0])
    x = (x ^ (x >> U64(27))) * U64(STEPS[1])
    return x ^ (x >> U64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(BASE) + U64(seed)) | U64(1)


BYTE_CODES = seeds(256, 11)
INVERSE = pow(BASE, -1, 1 << 64)


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2^64."""
    out = []
    for base in (BASE, INVERSE):
        p = np.full(n, base, dtype=U64)
        p[:1] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


@functools.cache
def _slice_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers_of(POWERS)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of a slice are kept; those of a longer text are not."""
    up, down = _slice_powers() if n <= POWERS else _powers_of(n)
    return up[:n], down[:n]


def give_back() -> None:
    """Return the memory that freed arrays still hold to the system: workers wait between tasks beside each other."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and its n + 1 offsets; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def row_slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one longer row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes in the given closed ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


def lowered() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lowered()
# Words between white space, and words of letters, digits and non-ASCII characters.
SPACED = ~byte_table((0x09, 0x0D), (0x20, 0x20))
ALNUM = byte_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes in order, their start bytes, and for each row the number of its first word (n + 1 values).

    data holds exactly the bytes of the rows and offsets start at 0. A-Z count as a-z.
    """
    low = LOWER[data]
    inside = table[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1]
    edges = edges[(edges < offsets[1:])]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    firsts = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, U64), starts, firsts
    up, down = powers(len(data))
    codes = np.where(inside, BYTE_CODES[low], U64(0))
    codes *= up
    hashes = np.add.reduceat(codes, starts)
    hashes *= down[starts]
    return mix(hashes), starts, firsts


def shingles(hashes: np.ndarray, firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words by row, and each row's first shingle (n + 1 values).

    A row of fewer words has its whole sequence as one shingle, a row without words none.
    """
    counts = np.diff(firsts)
    n_out = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    begin = np.concatenate([[0], np.cumsum(n_out)])
    factors = seeds(size, 29)
    total = len(hashes)
    joined = np.zeros(max(total - size + 1, 0), dtype=U64)
    for j in range(size):
        joined += hashes[j : j + len(joined)] * factors[j]
    joined = mix(joined)
    # Position of each shingle's first word: rows follow each other without gaps.
    at = np.arange(begin[-1]) + np.repeat(firsts[:-1] - begin[:-1], n_out)
    out = np.zeros(begin[-1], dtype=U64)
    long_row = np.repeat(counts >= size, n_out)
    out[long_row] = joined[at[long_row]]
    for row in np.flatnonzero((counts > 0) & (counts < size)):
        h = hashes[firsts[row] : firsts[row + 1]]
        out[begin[row]] = mix(np.array([(h * factors[: len(h)]).sum(dtype=U64) + U64(len(h))], dtype=U64))[0]
    return out, begin


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, the bytes and the offsets from 0 of each slice of a text column."""
    for begin in range(0, max(len(column), 1), ROWS):
        data, offsets = column_bytes(column.slice(begin, ROWS))
        for first, last in row_slices(offsets, limit):
            low, high = int(offsets[first]), int(offsets[last])
            yield begin + first, begin + last, data[low:high], offsets[first : last + 1] - low
    give_back()
