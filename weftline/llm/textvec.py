"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is ``[^\\x20\\x09-\\x0D]+``. All separators are single bytes below 0x80, so bytes can be
classed without decoding. Words are known by 64-bit hashes: a polynomial over random byte codes,
mixed; the same for every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        table = np.full(max(n, 1 << 20), _BASE if which == "up" else _INVERSE, np.uint64)
        table[0] = 1
        _powers[which] = np.cumprod(table, dtype=np.uint64)
    return _powers[which]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as numbers in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def pieces(batch: pa.RecordBatch, column: str, limit: int = 250_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` text bytes, one row at least: bounds what one step holds."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins (n + 1 offsets). Null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; other bytes stay."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of words of each text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~SEPARATOR[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.diff(np.searchsorted(start, offsets))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the span stands."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODES[data] * _power("up", n)[:n], out=total[1:])
    return mix((total[end] - total[start]) * _power("down", n + 1)[start] + (end - start).astype(np.uint64))


class Lookup:
    """Places of 64-bit keys (not 0) by open addressing: a few reads for each key, all keys at once."""

    def __init__(self, keys: np.ndarray) -> None:
        self.size = 1 << max(4, int(len(keys) * 3 // 2).bit_length())
        self.keys, self.places = np.zeros(self.size, np.uint64), np.zeros(self.size, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            at, first = np.unique(slot[free], return_index=True)
            self.keys[at], self.places[at] = keys[free[first]], free[first]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & (self.size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) & np.uint64(self.size - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if it is not there."""
        out = np.full(len(keys), -1, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            met = self.keys[slot[left]]
            hit = met == keys[left]
            out[left[hit]] = self.places[slot[left[hit]]]
            left = left[~hit & (met != 0)]
            slot[left] = (slot[left] + 1) & (self.size - 1)
        return out
