"""Word shingles of many texts as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from clinspan.llm import octets

WORDS = 5


def hashes(data: np.ndarray, offsets: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``width`` words, first index of each row's hashes and the end of the last).

    Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased. A row of fewer words
    has the hash of all of them as its only one; a row without words has none.
    """
    data = octets.lower(data)
    starts, stops, row = octets.words(data, offsets)
    rows = len(offsets) - 1
    count = np.bincount(row, minlength=rows)
    word = octets.range_hash(octets.prefix_hash(data), starts, stops)
    base = octets.BASE
    made = np.zeros(len(word), np.uint64)
    last = np.cumsum(count)
    left = last[row] - np.arange(len(word)) if len(word) else np.zeros(0, np.int64)
    for k in range(width):
        made *= base
        there = left > k
        made[there] += word[np.flatnonzero(there) + k]
    made = octets.mix(made + np.minimum(left, width).astype(np.uint64))
    # A whole shingle starts here, or the row is short and this is its first word.
    short = count < width
    keep = (left >= width) | (short[row] & (left == count[row]))
    sizes = np.where(short, np.minimum(count, 1), count - width + 1)
    return made[keep], np.r_[0, np.cumsum(sizes)]


def sets(column: pa.Array, last: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The distinct shingles of each text in ascending order of 64-bit codes.

    A code is the hash without its lowest bit; those in ``last`` (sorted codes) get the top bit, so
    they come after all others.
    """
    for _, _, data, offsets in octets.slices(column):
        made, ends = hashes(data, offsets)
        made >>= np.uint64(1)
        if last is not None and len(last):
            at = np.minimum(np.searchsorted(last, made), len(last) - 1)
            made |= (last[at] == made).astype(np.uint64) << np.uint64(63)
        ends = ends.tolist()
        for a, z in zip(ends[:-1], ends[1:]):
            some = np.sort(made[a:z])
            if z - a > 1:
                new = np.empty(z - a, bool)
                new[0] = True
                np.not_equal(some[1:], some[:-1], out=new[1:])
                some = some[new]
            yield some
