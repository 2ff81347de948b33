"""Vectorised words, hashes and shingles over Arrow string columns (numpy, inside tasks).

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``. In UTF-8 those bytes never
occur inside a multi-byte character, so words are found on the raw bytes of the column.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are handled at once; a single longer text is still handled whole.
SLICE_BYTES = 1 << 19

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values (shift-xor-multiply rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def _byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, _M64, size=256, dtype=np.uint64, endpoint=True)


def _base(seed: int) -> int:
    return (0x9E3779B97F4A7C15 * (2 * seed + 1)) & _M64 | 1


_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(seed: int, n: int, inverse: bool = False) -> np.ndarray:
    """``base**i`` modulo 2**64 for i < n (or of the inverse base); kept for the next call."""
    have = _powers.get((seed, inverse))
    if have is None or len(have) < n:
        base = _base(seed)
        if inverse:
            base = pow(base, -1, 1 << 64)
        size = max(1 << 16, 1 << (n - 1).bit_length() if n > 1 else 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[(seed, inverse)] = have
    return have[:n]


def drop_powers() -> None:
    """Forget the powers of long texts."""
    for key in [k for k, have in _powers.items() if len(have) > 1 << 16]:
        del _powers[key]


@dataclass
class Words:
    """Words of a slice of documents: byte spans, and ``first[d]:first[d+1]`` for document d."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, seed: int) -> np.ndarray:
        """A 64-bit hash of each word: polynomial over random byte values, then scrambled."""
        if not len(self.starts):
            return np.empty(0, dtype=np.uint64)
        n = len(self.data)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_byte_values(seed)[self.data] * powers(seed, n), out=total[1:])
        own = (total[self.ends] - total[self.starts]) * powers(seed, n, inverse=True)[self.starts]
        return mix(own + (self.ends - self.starts).astype(np.uint64))


def window_hashes(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes (len(h) - k + 1 values)."""
    m = len(h) - k + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    weight = powers(seed + 1000, k)
    out = np.zeros(m, dtype=np.uint64)
    for i in range(k):
        out += h[i:i + m] * weight[i]
    return mix(out)


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each run of ``k`` consecutive values."""
    m = len(x) - k + 1
    if m <= 0:
        return x[:0]
    have, out = 1, x
    while have * 2 <= k:
        out = np.minimum(out[:len(out) - have], out[have:])
        have *= 2
    return np.minimum(out[:m], out[k - have:k - have + m])


def whole(first: np.ndarray, k: int) -> np.ndarray:
    """Positions i for which words i .. i+k-1 all lie in one document."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    total = int(counts.sum())
    shift = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)
    return np.arange(total) + shift


def slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = SLICE_BYTES):
    """``batch`` in runs of whole rows of about ``max_bytes`` of text."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0))
    ends, start = np.cumsum(sizes.astype(np.int64)), 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return raw[offs[0]:offs[-1]] if len(offs) else raw[:0], offs - (offs[0] if len(offs) else 0)


def words_of(col: pa.Array, lower: bool = False, between: np.ndarray = _SEPARATOR) -> Words:
    """Words of a string column; ``between`` says which bytes separate them."""
    data, offs = text_bytes(col)
    if lower:
        data = _LOWER[data]
    if not len(data):
        none = np.empty(0, dtype=np.int64)
        return Words(data, none, none, np.zeros(len(col) + 1, dtype=np.int64))
    sep = between[data]
    before = np.empty(len(data), dtype=bool)
    before[0], before[1:] = True, sep[:-1]
    inner = offs[1:-1][offs[1:-1] < len(data)]
    before[inner] = True
    after = np.empty(len(data), dtype=bool)
    after[-1], after[:-1] = True, sep[1:]
    after[inner[inner > 0] - 1] = True
    starts = np.flatnonzero(~sep & before)
    ends = np.flatnonzero(~sep & after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offs))


def int64(x: np.ndarray) -> pa.Array:
    """Unsigned hashes as Spark longs (same bits)."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))
