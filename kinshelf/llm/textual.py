"""Vectorised views of Arrow text columns: words, hashes and n-grams, without Python objects per word.

All hashes are polynomial sums modulo 2**64 over mixed symbols. Where a result depends
on equality alone, callers take two independent ones (``SALTS``), that is 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multipliers of the two independent hash families.
SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Texts are worked on in runs of about so many bytes; a longer text is a run of its own.
RUN_BYTES = 1 << 20
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the start of each row in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, where, data = column.buffers()
    starts = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def runs(starts: np.ndarray, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``most`` bytes, one row at least."""
    first, rows = 0, len(starts) - 1
    while first < rows:
        last = int(np.searchsorted(starts, starts[first] + most, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others (a fixed bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(salt: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd number modulo 2**64, and of its inverse."""
    known = _POWERS.get(salt)
    if known is None or len(known[0]) < count:
        size = max(count, 1 << 16)
        inverse = pow(salt, -1, 1 << 64)
        with np.errstate(over="ignore"):
            up, down = np.full(size, salt, np.uint64), np.full(size, inverse, np.uint64)
            up[0] = down[0] = 1
            known = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size <= 4 * RUN_BYTES:
            _POWERS[salt] = known
    return known


def span_hashes(symbols: np.ndarray, first: np.ndarray, last: np.ndarray, salt: int) -> np.ndarray:
    """Hash of ``symbols[first:last]`` for each pair; equal spans have equal hashes anywhere."""
    with np.errstate(over="ignore"):
        up, down = _powers(salt, len(symbols) + 1)
        sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[: len(symbols)], out=sums[1:])
        return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))


def byte_symbols(data: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit symbol for every byte."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, 257, dtype=np.uint64)) * np.uint64(salt))[data]


def mask_of(*spans: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, true inside the inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in spans:
        table[low : high + 1] = True
    return table


#: All but space and the five ASCII controls from tab to carriage return.
NOT_BLANK = ~mask_of((0x09, 0x0D), (0x20, 0x20))


def word_spans(data: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches of bytes that ``inside`` flags: their starts, ends, and the first one of each row.

    No word crosses the border of two rows. The last array has an entry more than rows.
    """
    flags = inside[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[:-1] = flags
    begins[1:-1] &= ~flags[:-1]
    ends = np.zeros(len(data) + 1, bool)
    ends[1:] = flags
    ends[1:-1] &= ~flags[1:]
    borders = starts[(starts > 0) & (starts < len(data))]
    begins[borders] |= flags[borders]
    ends[borders] |= flags[borders - 1]
    first = np.flatnonzero(begins[:-1])
    return first, np.flatnonzero(ends), np.searchsorted(first, starts)


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return span_hashes(byte_symbols(data, SALTS[1]), first, last, SALTS[0])


def pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def joined(blobs, dtype=np.uint64) -> np.ndarray:
    """The arrays in a column of packed values, one after another."""
    return np.frombuffer(b"".join(b for b in blobs if b), dtype)
