"""Helpers that run inside tasks: words and their hashes, over the raw bytes of an Arrow column.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. Work is done on slices of a few
megabytes of text, so a task's memory does not grow with its partition; a text longer than a slice
is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 20
LONG_WORD = 64

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
LOWER = _LOWER.astype(np.uint8)


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows with about `most` bytes of text each."""
    col = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pc.binary_length(col).fill_null(0))
    if not len(sizes):
        return
    part = np.cumsum(sizes, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each row begins; a null is an empty text."""
    col = col.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


class Words:
    """Words of a slice: start and end bytes, and where each row's words begin."""

    def __init__(self, col: pa.Array, gaps: np.ndarray = _SPACE):
        """`gaps`: for each byte whether it parts words."""
        self.buf, self.rows = raw(col)
        solid = ~gaps[self.buf]
        inner = self.rows[1:-1]
        before = np.zeros_like(solid)
        before[1:] = solid[:-1]
        before[inner[inner < len(solid)]] = False
        after = np.zeros_like(solid)
        after[:-1] = solid[1:]
        after[inner[inner > 0] - 1] = False
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.starts, self.rows)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word, of its lower-case form (A-Z only) if `lower`."""
        table = _BYTE_LOWER if lower else _BYTE
        size = self.ends - self.starts
        h = size.astype(np.uint64) * _BASE
        live = np.flatnonzero(size <= LONG_WORD)
        at = self.starts[live]
        left = size[live]
        acc = h[live]
        k = 0
        while len(live):
            acc = (acc * _M2) + table[self.buf[at + k]]
            k += 1
            done = left == k
            if done.any():
                h[live[done]] = acc[done]
                keep = ~done
                live, at, left, acc = live[keep], at[keep], left[keep], acc[keep]
        for i in np.flatnonzero(size > LONG_WORD):
            word = self.buf[self.starts[i]:self.ends[i]].tobytes()
            h[i] = xxhash.xxh3_64_intdigest(word.lower() if lower else word)
        return mix(h)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries; entry i covers i .. i+k-1 (rows are not looked at)."""
    n = max(len(words) - k + 1, 0)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc = acc * _M1 + words[j:j + n]
    return mix(acc)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_M1**i and its inverse modulo 2**64, for i < n."""
    inverse = np.uint64(pow(int(_M1), -1, 1 << 64))
    up, down = np.full(n, _M1), np.full(n, inverse)
    if n:
        up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
