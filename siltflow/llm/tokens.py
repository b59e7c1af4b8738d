"""Words and hashes of many texts at once, in numpy over Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multiplier of the polynomial word hash modulo 2^64 and its inverse.
ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U = np.uint64


@lru_cache(maxsize=4)
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def chunks(column: pa.Array | pa.ChunkedArray, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) over runs of whole texts of about `most` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


class Words:
    """The words of a chunk: start and end in bytes, the row of each, hashes of 64 bits."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs, self.n_rows = data, offs, len(offs) - 1
        n = len(data)
        blank = SPACE[data]
        cut = np.zeros(n + 1, bool)
        cut[offs] = True
        before = np.ones(n, bool)
        before[1:] = blank[:-1]
        after = np.ones(n, bool)
        after[:-1] = blank[1:]
        self.start = np.flatnonzero(~blank & (before | cut[:-1]))
        self.end = np.flatnonzero(~blank & (after | cut[1:])) + 1
        self.row = np.searchsorted(offs, self.start, "right") - 1
        self.per_row = np.bincount(self.row, minlength=self.n_rows)

    def hashes(self, table: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the words' bytes, mapped by table first; equal words have equal hashes."""
        return mix64(spans_hash(prefix(self.data if table is None else table[self.data]), self.start, self.end))


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of (byte + 1) * ODD^i modulo 2^64, with a leading 0."""
    size = 1 << max(12, int(len(data)).bit_length())
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + U(1)) * powers(ODD, size)[: len(data)], out=out[1:])
    return out


def spans_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = 1 << max(12, int(len(sums)).bit_length())
    return (sums[end] - sums[start]) * powers(INVERSE, size)[start]
