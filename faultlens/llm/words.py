"""Words of whole texts, in blocks of bounded size, and their hashes in numpy."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: ASCII white space; every other byte belongs to a word.
SPACE = re.compile(rb"[\x20\x09-\x0D]")
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes of text that are in numpy arrays at a time.
BLOCK = 1 << 20

#: An odd factor and its inverse modulo 2**64 (fixed values).
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)


def word_blocks(data: bytes, size: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of a text in order, about ``size`` bytes of it at a time."""
    low, n = 0, len(data)
    while low < n:
        high = low + size
        if high < n:
            space = SPACE.search(data, high)
            high = space.start() if space else n
        yield data[low:high].split()
        low = high


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (the finalizer of a well-known public hash)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@functools.cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _power(base: int, n: int) -> np.ndarray:
    return _powers(base, max(1 << 16, 1 << (n - 1).bit_length()))[:n] if n else _powers(base, 1 << 16)[:0]


class Hasher:
    """Hashes of any slices of a block of bytes, from one pass of prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(FACTOR, n), out=self.sums[1:])
        self.inverse = _power(INVERSE, n + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def runs(member: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a run also ends at each place in ``breaks``."""
    starts, ends = member.copy(), member.copy()
    starts[1:] &= ~member[:-1]
    ends[:-1] &= ~member[1:]
    inner = breaks[(breaks > 0) & (breaks < len(member))]
    starts[inner] = member[inner]
    ends[inner - 1] = member[inner - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


class Block(NamedTuple):
    """Texts laid end to end. ``bounds``: where in ``data`` its rows begin, and its end;
    ``first``: its first row; ``begins``, ``ends``: whether the first row begins and the
    last row ends here."""

    data: np.ndarray
    bounds: np.ndarray
    first: int
    begins: bool
    ends: bool


def text_blocks(column: pa.Array, size: int = BLOCK) -> Iterator[Block]:
    """The texts of a column, about ``size`` bytes at a time.

    A long text is cut at white space and goes on in the next block.
    """
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row, low = 0, int(offsets[0]) if len(offsets) else 0
    while row < len(column):
        # Whole rows that fit, or a part of one.
        last = int(np.searchsorted(offsets, low + size, side="right")) - 1
        if last > row:
            high = int(offsets[last])
        else:
            last, high = row + 1, int(offsets[row + 1])
            if high - low > size:
                space = SPACE.search(raw, low + size, high)
                if space:
                    last, high = row, space.start()
        inside = offsets[row:last + 1] if last > row else np.array([low, high])
        bounds = np.clip(inside, low, high) - low
        yield Block(data[low:high], bounds, row, low == int(offsets[row]), last > row)
        row, low = last, high
