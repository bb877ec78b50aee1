"""Token ids of texts from a table of distinct chunks, each encoded once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Bytes that a worker's table may take, as far as they can be told; at the bound it starts anew.
TABLE_BYTES = 96 << 20
#: What an entry takes besides its chunk and ids: the bytes object, the dictionary's slot, the number, two array places.
_ENTRY = 33 + 100 + 32 + 16


class ChunkTable:
    """Ids by chunk. ``encode`` gives (ids, lengths) for a list of chunks of bytes."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = TABLE_BYTES) -> None:
        self._encode, self._limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self._at: dict[bytes, int] = {}
        self._ids = np.zeros(1 << 16, np.uint32)
        self._starts = np.zeros(1 << 12, np.int64)
        self._lengths = np.zeros(1 << 12, np.int64)
        self._used = self._bytes = 0

    def _add(self, chunks: list[bytes]) -> None:
        ids, lengths = self._encode(chunks)
        n = len(self._at)
        for name, need in (("_ids", self._used + len(ids)), ("_starts", n + len(chunks)), ("_lengths", n + len(chunks))):
            own = getattr(self, name)
            if need > len(own):
                setattr(self, name, np.concatenate([own, np.zeros(max(need - len(own), len(own)), own.dtype)]))
        self._ids[self._used : self._used + len(ids)] = ids
        self._starts[n : n + len(chunks)] = self._used + np.cumsum(lengths) - lengths
        self._lengths[n : n + len(chunks)] = lengths
        self._used += len(ids)
        self._bytes += sum(map(len, chunks)) + _ENTRY * len(chunks) + 4 * len(ids)
        self._at.update(zip(chunks, range(n, n + len(chunks)), strict=True))

    def ids(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of data[cuts[i]:cuts[i + 1]] one after the other, and how many each has."""
        if len(cuts) < 2:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        pieces = pa.Array.from_buffers(
            pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
        ).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        if self._bytes > self._limit:
            self.clear()
        missing = [c for c in distinct if c not in self._at]
        if missing:
            self._add(missing)
        at = np.fromiter(map(self._at.__getitem__, distinct), np.int64, len(distinct))[np.asarray(pieces.indices)]
        lengths = self._lengths[at]
        ends = np.cumsum(lengths)
        out = self._ids[np.repeat(self._starts[at] - (ends - lengths), lengths) + np.arange(ends[-1])]
        return out, lengths
