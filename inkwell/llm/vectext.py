"""Vectorised word splitting and hashing over Arrow string columns.

All functions work on UTF-8 bytes. The word separators are ASCII, so a byte scan finds the same words as a scan of
code points. A chunk holds whole texts, about ``CHUNK_BYTES`` of them (one text alone if it is longer), which bounds
the temporary arrays of a task whatever the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift-multiply rounds)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_pow = {"up": _powers(_BASE, 1 << 16), "down": _powers(_BASE_INV, 1 << 16)}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow["up"]) < n:
        size = 1 << int(n).bit_length()
        _pow["up"], _pow["down"] = _powers(_BASE, size), _powers(_BASE_INV, size)
    return _pow["up"], _pow["down"]


@dataclass
class Chunk:
    """Whole texts: ``data`` holds their bytes, text i at ``bounds[i]:bounds[i+1]``; ``first`` is its row in the batch."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column into chunks of whole texts; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return
    _, off, data = column.buffers()
    bounds = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(bounds, bounds[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield Chunk(row, data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row])
        row = end


@dataclass
class Words:
    """Words of a chunk in order: byte span, 64-bit hash; ``bounds[i]:bounds[i+1]`` are the words of text i."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z folded."""
    return _LOWER[data]


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, from prefix sums of a polynomial over random byte codes."""
    n = len(data)
    up, down = _tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def words(chunk: Chunk, lower: bool = False, hashed: bool = True) -> Words:
    """Maximal runs of bytes other than U+0020 and U+0009 to U+000D; ``lower`` folds A-Z before hashing."""
    data, n = chunk.data, len(chunk.data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(len(chunk) + 1, np.int64))
    solid = ~_IS_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = chunk.bounds[(chunk.bounds > 0) & (chunk.bounds < n)]  # texts meet without a separator
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    bounds = np.searchsorted(start, chunk.bounds)
    value = np.zeros(0, np.uint64)
    if hashed:
        value = span_hash(_LOWER[data] if lower else data, start, end)
    return Words(start, end, value, bounds)


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of two hashes."""
    return mix(left * _PAIR + right)


def ngram_hash(value: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n neighbouring hashes (the caller drops runs that cross texts)."""
    out = value[: max(len(value) - n + 1, 0)]
    for k in range(1, n):
        out = pair_hash(out, value[k : len(value) - n + 1 + k])
    return out
