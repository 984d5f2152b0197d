"""Count-min sketches of 64-bit items, with counters that stop at two, merged over partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .packets import by_slice, pack, packets, unpack

#: Odd multipliers of the sketch rows.
ROWS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: Cells of a slice of a row.
SLICE = 1 << 18


def log_width(items: int, most: int = 28) -> int:
    """Cells of a row, as a power of two: twice the expected items at least, and at most 2**most (2**(most - 3) bytes a row)."""
    return min(most, max(18, int(2 * max(1, items) - 1).bit_length()))


def cells(items: np.ndarray, row: int, width: int) -> np.ndarray:
    mixed = (items ^ (items >> np.uint64(29))) * ROWS[row]
    return ((mixed ^ (mixed >> np.uint64(32))) * ROWS[row] >> np.uint64(64 - width)).astype(np.int64)


def gaps(at: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers as bytes: the numbers left out between them, 255 standing for 255 of them and more to come."""
    between = np.diff(at, prepend=-1) - 1
    many = between // 255
    out = np.full(len(at) + int(many.sum()), 255, np.uint8)
    out[np.cumsum(many + 1) - 1] = between % 255
    return out


def places(gap: np.ndarray) -> np.ndarray:
    end = gap != 255
    return np.cumsum(gap, dtype=np.int64)[end] + np.arange(int(end.sum()))


def _bits(at: np.ndarray) -> np.ndarray:
    bits = np.zeros(SLICE, bool)
    bits[at] = True
    return np.packbits(bits)


class Partial:
    """The sketch of one task's items, kept as sorted cells and flushed as packets of (cells seen once, cells seen more often)."""

    def __init__(self, width: int, flush_items: int = 3_000_000) -> None:
        self.width, self.flush_items, self.items, self.n = width, flush_items, [], 0

    def add(self, items: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.items.append(items)
        self.n += len(items)
        if self.n >= self.flush_items:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        items, self.items, self.n = np.concatenate(self.items), [], 0
        for row in range(len(ROWS)):
            at = np.sort(cells(items, row, self.width))
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            many = np.diff(np.concatenate((first, [len(at)]))) > 1
            at = at[first]
            cuts, out = np.searchsorted(at, np.arange(0, (1 << self.width) + 1, SLICE)), []
            for s, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                if a < b:
                    local = at[a:b] - s * SLICE
                    out.append(((row << 16) + s, pack(gaps(local), gaps(local[many[a:b]]))))
            yield packets(out)


def _merge(number: int, payloads: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    once, twice = np.zeros(SLICE // 8, np.uint8), np.zeros(SLICE // 8, np.uint8)
    for p in payloads:
        a, b = (_bits(places(x)) for x in unpack(p, "u1", "u1"))
        twice |= b | (once & a)
        once |= a
    yield packets([(number, zstandard.compress(twice.tobytes(), 1))])


def merged(partials: DataFrame, width: int) -> bytes:
    """Bits of the cells whose merged count is two or more, row by row, on the driver; ``width`` bounds their number.

    They are bytes because a worker reads those from a broadcast without a second copy.
    """
    bits = np.zeros((len(ROWS), (1 << width) // 8), np.uint8)
    for number, payload in by_slice(partials, _merge, "slice int, payload binary").toLocalIterator():
        row, s = number >> 16, number & 0xFFFF
        bits[row, s * SLICE // 8 : (s + 1) * SLICE // 8] = np.frombuffer(zstandard.decompress(bytes(payload)), np.uint8)
    return bits.tobytes()


def repeated(bits: bytes, items: np.ndarray, width: int) -> np.ndarray:
    """True where the estimated count of an item is two or more; true for every item that is repeated."""
    rows = np.frombuffer(bits, np.uint8).reshape(len(ROWS), -1)
    left = np.arange(len(items))
    for row in range(len(ROWS)):  # few items pass the first row where most occur once
        at = cells(items[left], row, width)
        left = left[(rows[row][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
    out = np.zeros(len(items), bool)
    out[left] = True
    return out
