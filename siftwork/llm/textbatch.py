"""Arrow text columns as one byte buffer: words and 64-bit hashes by numpy.

A block holds some whole texts end to end. Nothing here loops over bytes or
words in Python, and a block holds BLOCK_BYTES at most, or one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
BASE = np.uint64(int(_rng.integers(0, 2**61)) * 8 + 5)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))

#: The white space of the word pattern: a blank, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n, modulo 2**64."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((BASE, INVERSE)):
            x = np.full(n + n // 4 + 2, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about limit bytes, one row at least."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, ends = 0, np.cumsum(size, dtype=np.int64)
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; a null counts as empty."""
    col = column.cast(pa.large_binary())
    if col.null_count:
        col = pc.fill_null(col, b"")
    _, offsets, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


class Block:
    """buf: bytes (A-Z lowered if asked); off: offsets of the texts in it."""

    def __init__(self, column: pa.Array, lower: bool = True):
        self.buf, self.off = unpack(column)
        if lower:
            self.buf = LOWER[self.buf]

    def words(self) -> None:
        """Adds starts, ends and doc (index of the text) of every word."""
        n = len(self.buf)
        solid = ~SPACE[self.buf]
        before = np.empty(n + 1, bool)
        before[0] = False
        before[1:] = solid
        after = np.empty(n + 1, bool)
        after[:n] = solid
        after[n] = False
        cut = np.zeros(n + 1, bool)
        cut[self.off] = True
        self.starts = np.flatnonzero(after & (~before | cut))
        self.ends = np.flatnonzero(before & (~after | cut))
        self.doc = np.searchsorted(self.off, self.starts, "right") - 1
        #: Of each text: how many words stand before it.
        self.first = np.searchsorted(self.starts, self.off)

    def sums(self) -> np.ndarray:
        """Prefix sums of the polynomial hash."""
        up, _ = powers(len(self.buf))
        out = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum(BYTE[self.buf] * up[: len(self.buf)], out=out[1:])
        return out

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte strings from starts to ends."""
        _, down = powers(len(self.buf))
        s = self.sums()
        return mix((s[ends] - s[starts]) * down[starts])


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within each text, and the texts' offsets
    among them; a text of 1 to k-1 words has its whole sequence as its one."""
    n = np.diff(first)
    many = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    offsets = np.concatenate([[0], np.cumsum(many)])
    at = np.arange(offsets[-1]) + np.repeat(first[:-1] - offsets[:-1], many)
    size = np.repeat(np.minimum(n, k), many)
    out = np.zeros(len(at), np.uint64)
    for i in range(k):
        inside = i < size
        h = words[np.minimum(at + i, max(len(words) - 1, 0))] if len(words) else np.zeros(0, np.uint64)
        out = np.where(inside, out * np.uint64(0x9E3779B97F4A7C15) + h, out)
    return mix(out + size.astype(np.uint64)), offsets
