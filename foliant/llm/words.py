"""Vectorised word and byte-window hashing over Arrow string columns.

A word is a run of bytes other than space and \\x09-\\x0D; documents never
share a word or a window.  Everything works on slices of bounded text size, so
memory does not depend on the number of rows in a batch.  Hashes are 64-bit
polynomial values over the UTF-8 bytes, finished with an avalanche step, and
equal in every process.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

def release() -> None:
    """Hand free memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def give_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, after which a Python worker, kept for later tasks, does not hold on to what this one used."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return tidy


U64 = np.uint64
SLICE_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


with np.errstate(over="ignore"):
    BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
RADIX = 0xD1342543DE82EF95
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII letters and digits and all bytes of other characters make words; the rest separates.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """RADIX**i and its inverse for i in 0..n, kept between calls."""
    if len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        for k, base in enumerate((RADIX, _inverse(RADIX))):
            factors = np.full(size, base, U64)
            factors[0] = 1
            _powers[k] = np.multiply.accumulate(factors)
    return _powers[0], _powers[1]


@dataclass
class Slice:
    """Some documents of a batch: their bytes, offsets and row numbers."""

    first_row: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into runs of whole documents of about `limit` bytes."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), len(column))
        yield Slice(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j]-H[i] == RADIX**i * hash(data[i:j])."""
    forward, _ = powers(len(data))
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_VALUE[data] * forward[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, back = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * back[start])


@dataclass
class Words:
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    key: np.ndarray


def words(part: Slice, *, lower: bool, separators: np.ndarray = SPACE) -> Words:
    """The words of a slice in order: row within the slice, byte range and hash."""
    data = LOWER[part.data] if lower else part.data
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~separators[data]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    cuts = part.offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[1:-1][cuts]
    last[cuts - 1] = inside[1:-1][cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(part.offsets, start, "right") - 1
    return Words(row, start, end, range_hash(prefix_hash(data), start, end))


def grams(found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of every n-word window inside one document."""
    size = len(found.row) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    total = np.zeros(size, U64)
    for k in range(n):
        total = total * U64(0x9FB21C651E98DF25) + found.key[k : k + size]
    at = np.flatnonzero(found.row[:size] == found.row[n - 1 :])
    return at, mix(total[at])
