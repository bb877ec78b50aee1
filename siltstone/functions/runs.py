"""Runs of words as MD5 numbers, counted or hashed over the bytes of Arrow text columns: the whole slice at once, nothing a row in Python."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes and rows of text worked on at once: temporaries are a few dozen times that, whatever the batch holds.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 1 << 16
#: Messages hashed at once, and blocks of 64 bytes up to which they are; longer ones are hashed one by one.
_LANES, _BLOCKS = 4096, 4

#: Bytes of text.SHINGLE_WORD: all beyond ASCII are word characters, so the pattern holds on UTF-8 bytes.
SHINGLE_BYTES = np.zeros(256, bool)
SHINGLE_BYTES[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
#: Words that have been parted by spaces already.
SPACED_BYTES = np.ones(256, bool)
SPACED_BYTES[[0x0A, 0x20]] = False

# The shifts and constants of RFC 1321.
_SHIFTS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], np.uint32)
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint64).astype(np.uint32)
_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)
_ORDER = [*range(16), *((5 * k + 1) % 16 for k in range(16)), *((3 * k + 5) % 16 for k in range(16)), *((7 * k) % 16 for k in range(16))]


def _compress(state: list[np.ndarray], words: np.ndarray) -> None:
    """One block of each message into its state; words[k] has word k of all messages."""
    a, b, c, d = (s.copy() for s in state)
    f, t = np.empty_like(a), np.empty_like(a)
    for k in range(64):
        part = k >> 4
        if part == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif part == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif part == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += words[_ORDER[k]]
        f += _SINES[k]
        shift = _SHIFTS[part, k & 3]
        np.left_shift(f, shift, out=t)
        f >>= np.uint32(32) - shift
        f |= t
        f += b
        a, d, c, b, f = d, c, b, f, a
    for s, x in zip(state, (a, b, c, d), strict=True):
        s += x


def md5(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefix: bytes = b"") -> np.ndarray:
    """The MD5 of prefix + data[starts[i]:ends[i]] for every i, as rows of four numbers: its bytes from the left."""
    out = np.empty((len(starts), 4), np.uint32)
    own = len(prefix)
    blocks = (ends - starts + own + 8) // 64 + 1
    padded = np.concatenate([data, np.zeros(64 * _BLOCKS, np.uint8)])
    for n in range(1, _BLOCKS + 1):
        of = np.flatnonzero(blocks == n)
        width = 64 * n
        view = np.lib.stride_tricks.as_strided(padded, (len(padded) - width + 1, width - own), (1, 1))
        columns = np.arange(width - own)
        for at in range(0, len(of), _LANES):
            rows = of[at : at + _LANES]
            size = ends[rows] - starts[rows]
            block = np.empty((len(rows), width), np.uint8)
            block[:, :own] = np.frombuffer(prefix, np.uint8)
            block[:, own:] = view[starts[rows]]
            block[:, own:] *= columns < size[:, None]
            block[np.arange(len(rows)), own + size] = 0x80
            words = np.ascontiguousarray(block.view("<u4").T)
            words[-2] = (size + own) * 8
            state = [np.full(len(rows), s, np.uint32) for s in _START]
            for k in range(n):
                _compress(state, words[16 * k : 16 * k + 16])
            out[rows] = np.stack(state, axis=1)
    for i in np.flatnonzero(blocks > _BLOCKS):
        out[i] = np.frombuffer(hashlib.md5(prefix + data[starts[i] : ends[i]].tobytes()).digest(), "<u4")
    return out.byteswap()


def top52(digests: np.ndarray) -> np.ndarray:
    """The first 13 hexadecimal digits as a number."""
    return (digests[:, 0].astype(np.int64) << 20) | (digests[:, 1].astype(np.int64) >> 12)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, present) of at most ``limit`` bytes of the column's rows, or of one row; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    here = column.is_valid().to_numpy(zero_copy_only=False)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(len(column), at + SLICE_ROWS, max(end, at + 1))
        yield data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], here[at:end]
        at = end


class Words:
    """The words of rows that each end in a byte no word has, rewritten with one ``between`` after each.

    data: those bytes; starts, ends: of each word in data; bounds: of each row in the words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, between: int = 0x20) -> None:
        solid = kind[data]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        at = np.flatnonzero(first)
        lengths = np.flatnonzero(last) + 1 - at
        self.bounds = np.searchsorted(at, offsets)
        self.starts = np.zeros(len(at), np.int64)
        np.cumsum(lengths[:-1] + 1, out=self.starts[1:]) if len(at) else None
        self.ends = self.starts + lengths
        self.data = np.full(int(self.ends[-1]) + 1 if len(at) else 0, between, np.uint8)
        inside = np.ones(len(self.data), bool)
        inside[self.ends] = False
        self.data[inside] = data[solid]

    def runs(self, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, end) of all runs of n words, by row; ``short``: rows with fewer words are a run too."""
        counts = np.diff(self.bounds)
        row = np.repeat(np.arange(len(counts)), counts)
        stop = self.bounds[1:][row]
        k = np.arange(len(row))
        good = k + n <= stop
        if short:
            good |= (counts[row] < n) & (k == self.bounds[:-1][row])
        k, row, stop = k[good], row[good], stop[good]
        return row, self.starts[k], self.ends[np.minimum(k + n, stop) - 1]


def lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """values, which are in the order of their rows, as a list a row."""
    offsets = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))


def distinct_hashes(text: pa.Array, n: int, keep: int) -> pa.Array:
    """The distinct numbers, one class of ``keep``, of each row's runs of n words."""
    out = []
    for data, offsets, _ in slices(text):
        w = Words(data, offsets, SHINGLE_BYTES)
        row, start, end = w.runs(n)
        h = top52(md5(w.data, start, end))
        row, h = row[h % keep == 0], h[h % keep == 0]
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        out.append(lists(row[new], h[new], len(offsets) - 1))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64()))


def one_permutation(text: pa.Array, lone: pa.Array, n: int, buckets: int, step: int) -> pa.Array:
    """The signature of each row's runs of n words: of a row without words that of ``lone``; of a null row nulls.

    The top bits of a number choose a bucket, its low 32 bits compete there. An empty bucket takes the
    value of the next full one, going round, moved on by ``step`` for each bucket between.
    """
    bits, out, done = 52 - (buckets.bit_length() - 1), [], 0
    for data, offsets, here in slices(text):
        rows = len(here)
        w = Words(data, offsets, SHINGLE_BYTES)
        row, start, end = w.runs(n, short=True)
        h = top52(md5(w.data, start, end))
        empty = np.flatnonzero(here & (np.diff(w.bounds) == 0))
        if len(empty):
            keys = [lone[done + int(i)].as_py().encode() for i in empty]
            row = np.concatenate([row, empty])
            h = np.concatenate([h, [int(hashlib.md5(k).hexdigest()[:13], 16) for k in keys]])
        packed = np.sort((((row * buckets) + (h >> bits)) << 32) | (h & 0xFFFFFFFF))
        at = packed >> 32
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        held = np.zeros(rows * buckets, np.int64)
        full = np.zeros(rows * buckets, bool)
        held[at[new]], full[at[new]] = packed[new] & 0xFFFFFFFF, True
        held, full = held.reshape(rows, buckets), full.reshape(rows, buckets)
        # from the right, twice round: the next full bucket's value and how far it lies
        value, far = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        signed = np.empty((rows, buckets), np.int64)
        for b in range(2 * buckets - 1, -1, -1):
            k = b % buckets
            value = np.where(full[:, k], held[:, k], value)
            far = np.where(full[:, k], 0, far + 1)
            if b < buckets:
                signed[:, k] = (value + far * step) & 0xFFFFFFFF
        values = pa.array(signed.ravel(), mask=np.repeat(~here, buckets) if not here.all() else None)
        out.append(pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * buckets), values))
        done += rows
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64()))


def run_counts(text: pa.Array, n: int, between: int = 0x20, prefix: bytes = b"") -> pa.Array:
    """{runs, distinct, low}: how many runs of n words a row has, how many are distinct, and of how many of these the MD5's first bit is 0."""
    total, kinds, low = [], [], []
    for data, offsets, _ in slices(text):
        rows = len(offsets) - 1
        w = Words(data, offsets, SPACED_BYTES, between)
        row, start, end = w.runs(n)
        d = md5(w.data, start, end, prefix).astype(np.uint64)
        a, b = (d[:, 0] << np.uint64(32)) | d[:, 1], (d[:, 2] << np.uint64(32)) | d[:, 3]
        order = np.lexsort((b, a, row))
        row, a, b = row[order], a[order], b[order]
        new = np.ones(len(row), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (row[1:] != row[:-1])
        total.append(np.bincount(row, minlength=rows))
        kinds.append(np.bincount(row[new], minlength=rows))
        low.append(np.bincount(row[new & (a < np.uint64(1 << 63))], minlength=rows))
    of = lambda x: pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64))
    return pa.StructArray.from_arrays([of(total), of(kinds), of(low)], ["runs", "distinct", "low"])
