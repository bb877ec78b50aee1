"""Vectorised work on the bytes of Arrow text columns: words, exact XXH64 of byte ranges, rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once: temporaries are a few dozen times that, whatever the batch holds.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# The five primes of the published XXH64 specification.
P1 = np.uint64(0x9E3779B185EBCA87)
P2 = np.uint64(0xC2B2AE3D27D4EB4F)
P3 = np.uint64(0x165667B19E3779F9)
P4 = np.uint64(0x85EBCA77C2B2AE63)
P5 = np.uint64(0x27D4EB2F165667C5)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds at most ``limit`` bytes in each, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, offsets = text_buffers(batch.column(column))
        at = 0
        while at < n:
            end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            end = min(n, max(end, at + 1))
            yield batch.slice(at, end - at)
            at = end


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the rows' offsets in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of rows, rewritten with one space after each.

    data: those bytes; starts, ends: of each word in data; bounds: of each row in the words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        solid = ~_SPACE[data]
        first, last = solid.copy(), solid.copy()
        if len(data):
            first[1:] &= ~solid[:-1]
            last[:-1] &= ~solid[1:]
            heads = offsets[:-1][offsets[:-1] < offsets[1:]]
            tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
            first[heads] = solid[heads]
            last[tails] = solid[tails]
        at = np.flatnonzero(first)
        lengths = np.flatnonzero(last) + 1 - at
        self.bounds = np.searchsorted(at, offsets)
        n = len(at)
        self.starts = np.zeros(n, np.int64)
        np.cumsum(lengths[:-1] + 1, out=self.starts[1:]) if n else None
        self.ends = self.starts + lengths
        self.data = np.full(int(self.ends[-1]) + 1 if n else 0, 0x20, np.uint8)
        inside = np.ones(len(self.data), bool)
        inside[self.ends] = False
        self.data[inside] = data[solid]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[starts[i]:ends[i]] for every i, as the published algorithm gives it."""
    with np.errstate(over="ignore"):
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        lane8 = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
        lane4 = np.ndarray((len(padded) - 3,), "<u4", padded.data, strides=(1,))
        seed_ = np.uint64(seed)
        length = ends - starts
        h = np.full(len(starts), seed_ + P5, np.uint64)
        at = starts.copy()
        if len(long := np.flatnonzero(length >= 32)):
            v = [np.full(len(long), x, np.uint64) for x in (seed_ + P1 + P2, seed_ + P2, seed_, seed_ - P1)]
            stripes, p = length[long] // 32, starts[long].copy()
            left, k = np.arange(len(long)), 0
            while len(left):
                for j in range(4):
                    v[j][left] = _round(v[j][left], lane8[p[left] + 8 * j])
                p[left] += 32
                k += 1
                left = left[stripes[left] > k]
            total = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                total = (total ^ _round(np.zeros(len(long), np.uint64), x)) * P1 + P4
            h[long], at[long] = total, p
        h += length.astype(np.uint64)
        rest = length & 31
        for k in range(3):
            on = np.flatnonzero(rest >= 8 * (k + 1))
            if not len(on):
                break
            x = _rotl(lane8[at[on]] * P2, 31) * P1
            h[on] = _rotl(h[on] ^ x, 27) * P1 + P4
            at[on] += 8
        on = np.flatnonzero(rest & 4)
        h[on] = _rotl(h[on] ^ (lane4[at[on]].astype(np.uint64) * P1), 23) * P2 + P3
        at[on] += 4
        for k in range(3):
            on = np.flatnonzero((rest & 3) > k)
            h[on] = _rotl(h[on] ^ (padded[at[on]].astype(np.uint64) * P5), 11) * P1
            at[on] += 1
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        h ^= h >> np.uint64(32)
    return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of XXH64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * P2
        x = (x ^ (x >> np.uint64(29))) * P3
        return x ^ (x >> np.uint64(32))


class Rolling:
    """Polynomial hashes modulo 2^64 of runs of a sequence of 64-bit values, from prefix sums."""

    _base = int(P4) | 1

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        with np.errstate(over="ignore"):
            self._inverse = self._powers(pow(self._base, -1, 1 << 64), n + 1)
            power = self._powers(self._base, n + 1)
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(values * power[:n], out=self._sums[1:])

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        done = 1
        while done < n:
            step = min(done, n - done)
            out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        return out

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self._sums[ends] - self._sums[starts]) * self._inverse[starts])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each run of ``width`` values: prefix and suffix minima of blocks, twice read."""
    n = len(values)
    if n < width:
        return values[:0]
    blocks = -(-n // width)
    full = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    full[:n] = values
    full = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])
