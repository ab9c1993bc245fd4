"""Words of many texts at once: numpy over the bytes of an Arrow column.

A word is a longest run of characters other than space and U+0009..U+000D. Its fingerprint is a
polynomial over random 64-bit values of its UTF-8 bytes, modulo 2**64, finished by a bit mixer. All
tasks use the same constants, so a word has one fingerprint everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C55  # 5 modulo 8: its powers differ in low bits as soon as any odd number can
_INVERSE = pow(_BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective bit mixer on uint64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_BYTE_LOWER = _BYTE[_LOWER]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, grown by doubling and kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.ones(size, U64)
        done = 1
        while done < size:
            have[done:2 * done] = have[:done] * U64(pow(base, done, 1 << 64))
            done *= 2
        _powers[base] = have
    return have[:n]


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for every span, before mixing."""
    sums = np.empty(len(values) + 1, U64)
    sums[0] = 0
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    return (sums[ends] - sums[starts]) * powers(pow(base, -1, 1 << 64), len(values) + 1)[starts]


@dataclass
class Words:
    """Rows first..last of a column: bytes, row bounds in bytes, words with byte spans, row bounds in words."""
    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row_words: np.ndarray  # word index at which each row starts; one more than rows

    def counts(self) -> np.ndarray:
        return np.diff(self.row_words)

    def hashes(self, lower: bool = False) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, U64)
        raw = spans_hash((_BYTE_LOWER if lower else _BYTE)[self.data], self.starts, self.ends, _BASE)
        return mix(raw + (self.ends - self.starts).astype(U64) * U64(0xA24BAED4963EE407))

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row_words) - 1), self.counts())


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row bounds of a string column; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    column = column.fill_null("") if column.null_count else column
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0]:bounds[-1]], bounds - bounds[0]


def word_slices(column: pa.Array, limit: int = 1 << 20, between: np.ndarray = SPACE) -> Iterator[Words]:
    """The column in slices of whole rows with about ``limit`` bytes; a longer text is a slice of its own.
    ``between`` tells the bytes that are in no word."""
    raw, bounds = column_bytes(column)
    row, rows = 0, len(bounds) - 1
    while row < rows:
        last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1)
        data = raw[bounds[row]:bounds[last]]
        own = bounds[row:last + 1] - bounds[row]
        space = np.empty(len(data) + 2, bool)
        space[0] = space[-1] = True
        space[1:-1] = between[data]
        begins = ~space[1:-1] & space[:-2]
        stops = ~space[1:-1] & space[2:]
        edges = own[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        begins[edges] = ~space[1:-1][edges]
        stops[edges - 1] = ~space[1:-1][edges - 1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        yield Words(row, last, data, own, starts, ends, np.searchsorted(starts, own))
        row = last
