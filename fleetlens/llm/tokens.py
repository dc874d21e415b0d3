"""Words of whole Arrow batches at once: places and 64-bit hashes without a Python object for each word.

A run (a word, a line) between separators has the hash sum(T[b_i] * P^(i - start)) mod 2^64, mixed. With prefix sums
S of T[b_j] * P^j over a chunk, that is (S[end] - S[start - 1]) * P^-start, so all runs cost a few vector operations.
T is a fixed random value for each byte, P an odd constant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

P = np.uint64(0x9E3779B97F4A7C15)
P_INVERSE = np.uint64(pow(int(P), -1, 1 << 64))
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
NEWLINE = np.zeros(256, dtype=bool)
NEWLINE[10] = True
BYTE_VALUES = np.random.Generator(np.random.PCG64(20240101)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The same with A-Z as a-z.
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[65:91] = BYTE_VALUES[97:123]
#: What a worker looks at together; its arrays of 64-bit values take some twenty times as much.
CHUNK_BYTES = 1 << 19

_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """P^j and P^-j for j below n at least."""
    if len(_powers[0]) < n:
        n = max(n, CHUNK_BYTES)
        for k, base in enumerate((P, P_INVERSE)):
            full = np.full(n, base, dtype=np.uint64)
            full[0] = 1
            _powers[k] = np.multiply.accumulate(full)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Chunk:
    """Some texts of a batch side by side: data (bytes), offsets (n + 1), first (row in the batch)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first, self.n = data, offsets, first, len(offsets) - 1

    def runs(self, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last positions of the runs between separator bytes; texts end runs too."""
        if not len(self.data):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        inside = ~separator[self.data]
        edge = np.zeros(len(self.data) + 1, dtype=bool)
        edge[self.offsets] = True
        edge[0] = True
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:]))
        return starts, ends

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums for hashes(); one call serves runs of any kind."""
        return np.cumsum(values[self.data] * powers(len(self.data) + 1)[0][: len(self.data)])

    def hashes(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, dtype=np.uint64)
        low = np.where(starts > 0, sums[starts - 1], np.uint64(0))
        return mix((sums[ends] - low) * powers(len(self.data) + 1)[1][starts])

    def per_text(self, places: np.ndarray) -> np.ndarray:
        """n + 1 bounds: which of the ascending places belong to each text."""
        return np.searchsorted(places, self.offsets)


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """A text column's chunks of about `size` bytes, whole texts only; nulls are empty."""
    values = batch.column(batch.schema.get_field_index(column))
    if not len(values):
        return
    values = values.cast(pa.large_binary())
    if values.null_count:
        values = values.fill_null(b"")
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    raw = values.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(values):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        end = min(end, len(values))
        yield Chunk(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], at)
        at = end


def words(chunk: Chunk, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the chunk, and the n + 1 bounds of each text's words."""
    starts, ends = chunk.runs(BLANK)
    return chunk.hashes(chunk.sums(LOWER_VALUES if lower else BYTE_VALUES), starts, ends), chunk.per_text(starts)


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of `size` words within a text and the windows' bounds; a shorter text is one window."""
    counts = np.diff(bounds)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(n)])
    first = np.repeat(bounds[:-1] - out_bounds[:-1], n) + np.arange(out_bounds[-1])
    whole = np.repeat(counts >= size, n)
    out = np.zeros(len(first), dtype=np.uint64)
    padded = np.concatenate([hashes, np.zeros(size, dtype=np.uint64)])
    left = np.repeat(bounds[1:], n) - first
    for k in range(size):
        out = mix(out * P + np.where(whole | (k < left), padded[first + k], np.uint64(0x5851F42D4C957F2D)))
    return out, out_bounds
