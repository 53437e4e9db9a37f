"""Words of whole texts as 64-bit numbers, computed in numpy over Arrow buffers.

The functions work on slices of at most about a megabyte of text (a longer single text makes its
own slice), so a task's memory does not depend on the partition's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1_000_000
#: Bytes whose powers and sums are held at once, however long a text or a word is.
SEGMENT_BYTES = 1 << 18
PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Inverse of PRIME modulo 2**64.
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * PRIME)
#: Words parted by blanks: [^\x20\x09-\x0D]+
BLANKS = np.zeros(256, dtype=bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: Words of letters and digits: every other ASCII character parts them.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((PRIME, INVERSE)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """The batch in runs of at most `rows` rows whose texts have about `limit` bytes together."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = np.unique(np.concatenate([np.flatnonzero(np.diff(piece)) + 1, np.arange(0, batch.num_rows, rows), [batch.num_rows]])).tolist()
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and where each begins; null counts as empty."""
    whole = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(whole.buffers()[1], dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


class Words:
    """Words of a run of texts: `hash`, byte `start` and `end` of each, and `first` word of each text."""

    def __init__(self, column: pa.Array, parts: np.ndarray = BLANKS, lower: bool = False):
        if lower:
            column = pc.utf8_lower(pc.fill_null(column, ""))
        self.bytes, self.offsets = text_buffer(column)
        n = len(self.bytes)
        if n == 0:
            self.start = self.end = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            self.first = np.zeros(len(self.offsets), np.int64)
            return
        inside = ~parts[self.bytes]
        breaks = np.zeros(n + 1, dtype=bool)
        breaks[self.offsets] = True
        before = np.empty(n, dtype=bool)
        before[0], before[1:] = False, inside[:-1]
        after = np.empty(n, dtype=bool)
        after[-1], after[:-1] = False, inside[1:]
        self.start = np.flatnonzero(inside & (~before | breaks[:n]))
        self.end = np.flatnonzero(inside & (~after | breaks[1:])) + 1
        self.hash = mix(self._sums())
        self.first = np.searchsorted(self.start, self.offsets)

    def _sums(self) -> np.ndarray:
        """Each word's bytes as a polynomial, a segment of the texts after the other; a word may go over several."""
        out = np.zeros(len(self.start), dtype=np.uint64)
        for a in range(0, len(self.bytes), SEGMENT_BYTES):
            part = self.bytes[a : a + SEGMENT_BYTES]
            lo, hi = np.searchsorted(self.end, a, side="right"), np.searchsorted(self.start, a + len(part))
            if lo == hi:
                continue
            begin, end = np.maximum(self.start[lo:hi] - a, 0), np.minimum(self.end[lo:hi] - a, len(part))
            up, down = powers(len(part))
            values = BYTE_VALUES[part] * up
            sums = np.cumsum(values, dtype=np.uint64)
            own = (sums[end - 1] - sums[begin] + values[begin]) * down[begin]
            if self.start[lo] < a:
                own[:1] *= np.array([pow(int(PRIME), int(a - self.start[lo]), 2**64)], dtype=np.uint64)
            out[lo:hi] += own
        return out


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A number for every run of k words; runs over the end of a text are the caller's to drop."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= PRIME
        out += hashes[j : j + n]
    return mix(out)


def text_keys(words: Words) -> np.ndarray:
    """One number for each text's whole sequence of words; 0 for a text without words."""
    up, down = powers(len(words.hash) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hash * up[: len(words.hash)], dtype=np.uint64)])
    a, b = words.first[:-1], words.first[1:]
    keys = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
    keys[keys == 0] = 1
    keys[a == b] = 0
    return keys


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start+1, ... of every range, one range after the other."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


def binary(rows: np.ndarray) -> pa.Array:
    """Each row of a two-dimensional array as one binary value."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return binary_runs(rows.reshape(-1), np.arange(len(rows) + 1) * width // rows.itemsize)


def binary_runs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """values[bounds[i]:bounds[i+1]] as the i-th binary value."""
    offsets = (np.asarray(bounds, dtype=np.int64) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])
