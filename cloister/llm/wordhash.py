"""Vectorised words of Arrow text columns: where they lie, whose they are, and 64-bit hashes of words and shingles.

All work is on the UTF-8 bytes of a column, a bounded slice at a time, so the memory of a task does
not depend on the batch size.  Hashes depend on the bytes alone and agree between executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SEED = 20240229
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWER = np.uint64(0xD6E8FEB86659FD93)
_POWER_INVERSE = np.uint64(pow(int(_POWER), -1, 2**64))

#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower_table() -> np.ndarray:
    """Byte -> byte, A-Z to a-z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def space_table() -> np.ndarray:
    """Bytes between words: 0x20 and 0x09 to 0x0D."""
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


_BYTE_VALUE = np.random.default_rng(_SEED).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_POWER, _POWER_INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.cumprod(factors, dtype=np.uint64)
    return _powers


@dataclass
class Words:
    """Words of consecutive texts. ``first[d]`` to ``first[d + 1]`` are those of text d."""

    starts: np.ndarray  # byte offsets within the slice
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows whose texts have about ``most`` bytes; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        end = min(end, len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def find_words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray, fold: np.ndarray | None = None) -> Words:
    """Words of a slice: runs of bytes that are not ``between`` (a table of 256); ``fold`` maps bytes before hashing."""
    inside = ~between[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | edge[:n])) if n else np.empty(0, np.int64)
    ends = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | edge[1:])) + 1 if n else np.empty(0, np.int64)
    first = np.searchsorted(starts, offsets)
    power, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    values = _BYTE_VALUE if fold is None else _BYTE_VALUE[fold]
    np.cumsum(values[data] * power[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts])
    return Words(starts, ends, first, hashes)


def shingle_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of runs of k words, first index of each text's); a text of fewer words, but not none, has its whole sequence as one."""
    counts = words.counts
    if k == 1:
        return words.hashes, words.first
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.concatenate(([0], np.cumsum(sizes)))
    start = np.repeat(words.first[:-1] - first[:-1], sizes) + np.arange(first[-1])
    left = np.repeat(words.first[1:], sizes) - start  # words from here to the end of the text
    out = np.full(len(start), np.uint64(k), np.uint64)
    if len(start):
        last = len(words.hashes) - 1
        for j in range(k):
            step = out * _ODD + words.hashes[np.minimum(start + j, last)]
            out = np.where(left > j, step, out * _ODD + np.uint64(1 + j))
    return mix(out), first
