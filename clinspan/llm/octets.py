"""Vectorised work on the bytes of many texts at once, for use inside Arrow map functions.

Texts of an Arrow batch are cut into slices of about ``SLICE_BYTES`` so that temporaries stay a few
megabytes whatever the batch holds; one very long text makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


class _Kept(dict):
    """A cache that does not travel with the functions that use it."""

    def __reduce__(self):
        return _Kept, ()


_POWERS = _Kept()


def mix(x: np.ndarray) -> np.ndarray:
    """A full-avalanche 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def name(parts: np.ndarray, salt: int) -> int:
    """A signed 64-bit name of an unordered set of hashes and a number."""
    total = mix(parts ^ BASE).sum(dtype=np.uint64, keepdims=True) + np.uint64(salt)
    return int(mix(total).view(np.int64)[0])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n, kept between calls."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, base in (("up", BASE), ("down", inverse)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _POWERS[name] = np.multiply.accumulate(table)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H[i] = sum of (data[j] + 1) * BASE**j for j < i, modulo 2**64; one entry more than data."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of data[start:stop], equal for equal bytes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[stop] - prefix[start]) * down[start] + (stop - start).astype(np.uint64))


def window_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` bytes, by its start."""
    n = len(prefix) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    _, down = powers(len(prefix))
    return mix((prefix[width:] - prefix[:-width]) * down[:n])


def words_at(data: bytes) -> np.ndarray:
    """The 8 bytes from each place on as one number, without a copy; ``data`` ends in 7 bytes to spare."""
    return np.ndarray((max(len(data) - 7, 0),), "<u8", data, strides=(1,))


_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word(words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``size`` bytes (8 at most; 0 or less: none) from each start, as one number each."""
    return words[np.minimum(start, len(words) - 1)] & _LOW_BYTES[np.clip(size, 0, 8)]


def name_ranges(words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each range of bytes, by its words: for short ranges that overlap."""
    out = mix(size.astype(np.uint64))
    for k in range(0, int(size.max(initial=0)), 8):
        out = mix(out ^ word(words, start + k, size - k))
    return out


def equal_ranges(words: np.ndarray, one: np.ndarray, two: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes of both ranges of each pair are equal."""
    same = np.ones(len(one), bool)
    for k in range(0, int(size.max(initial=0)), 8):
        same &= word(words, one + k, size - k) == word(words, two + k, size - k)
    return same


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, stops and rows of the runs of bytes that are neither space nor 0x09-0x0D, cut at the offsets."""
    solid = np.zeros(len(data) + 2, bool)
    np.logical_not((data == 32) | ((data >= 9) & (data <= 13)), out=solid[1:-1])
    begin = solid[1:-1] & ~solid[:-2]
    end = solid[1:-1] & ~solid[2:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begin[cut] = solid[1:-1][cut]
    end[cut - 1] = solid[1:-1][cut - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, side="right") - 1


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, values = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) for slices of about ``size`` bytes."""
    data, offsets = buffers(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def char_starts(data: np.ndarray) -> np.ndarray:
    """True at the first byte of each code point."""
    return (data & 0xC0) != 0x80


def run_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of values[starts[i]:starts[i + 1]] for each i; ``starts`` ends with len(values)."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]
