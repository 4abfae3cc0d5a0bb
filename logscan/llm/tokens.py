"""Vectorised words, shingles and hashes over the UTF-8 buffers of Arrow string columns.

Words are runs of bytes other than space and \\t \\n \\v \\f \\r. All hashes are 64 bits
wide; arithmetic wraps modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of text handled in one go; a longer document is a chunk of its own.
CHUNK = 1 << 18
U64 = np.uint64
_BASE, _WORD = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64; the longest table of each base is kept."""
    if base not in _tables or len(_tables[base]) < n:
        out = np.full(1 << max(16, int(n).bit_length()), base % (1 << 64), dtype=U64)
        out[0] = 1
        _tables[base] = np.multiply.accumulate(out, out=out)
    return _tables[base][:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


@lru_cache(maxsize=2)
def byte_values(lower: bool) -> np.ndarray:
    """A value for each byte, 0 for white space; with lower, A-Z count as a-z."""
    out = mix(np.arange(1, 257, dtype=U64) * U64(_WORD))
    out[list(SPACE)] = 0
    if lower:
        out[65:91] = out[97:123]
    return out


class Words:
    """The words of some texts: hash, number of the text, start and end byte of each, and the first word of each text."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = False):
        n = len(data)
        inside = np.ones(256, dtype=bool)
        inside[list(SPACE)] = False
        inside = inside[data]
        cut = np.zeros(n + 1, dtype=bool)
        cut[bounds] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | cut[1:n]
        self.starts = np.flatnonzero(begins)
        self.doc = np.searchsorted(bounds, self.starts, side="right") - 1
        if len(self.starts):
            sums = np.add.reduceat(byte_values(lower)[data] * powers(_BASE, n), self.starts)
            self.hash = mix(sums * powers(inverse(_BASE), n)[self.starts])
        else:
            self.hash = np.empty(0, dtype=U64)
        self.first = np.searchsorted(self.doc, np.arange(len(bounds)))
        self.counts = np.diff(self.first)

    def grams(self, k: int, seed: int = 0) -> np.ndarray:
        """A hash for each k consecutive words, those that cross into another text included."""
        return grams(self.hash, k, seed)


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    n = max(0, len(h) - k + 1)
    out, factor = np.zeros(n, dtype=U64), 1
    for j in range(k):
        out += h[j : j + n] * U64(factor)
        factor = factor * (_WORD + 2 * seed) % (1 << 64)
    return mix(out)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls (they count as empty), and where each text begins and the last one ends."""
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8), at


def chunks(column: pa.Array, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about CHUNK bytes, and no more than so many rows: first and end row, their bytes, and bounds within those."""
    data, at = buffers(column)
    row, n = 0, len(column)
    while row < n:
        end = min(row + rows, max(row + 1, int(np.searchsorted(at, at[row] + CHUNK, side="right")) - 1))
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end
