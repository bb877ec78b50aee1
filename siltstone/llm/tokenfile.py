"""Token ids in directly addressable codes.

A file holds ids in segments of up to ``SEGMENT``. In a segment each id is split into chunks of
eight bits. Level 0 has the lowest chunk of every id, level k + 1 the next chunk of those that go
on; a bitmap at each level says which do, and a rank directory counts its bits ahead of every block
of 512. Chunk k + 1 of the id at place i then stands at place rank(i) of level k + 1, so that any
token is read with a few fixed-offset reads, and a run of tokens from one run in each level. No
block is decoded for it.

Layout, little endian: magic; segments; footer (offset of each segment, ids in all, number of
segments, magic). Segment: number of levels, then for each level the number of its chunks, then for
each level its chunks, padded to 8; its bitmap in 64-bit words; its directory of 64-bit counts.

Documents are written in ascending order of id (null ids first, equal ids by text), in files that
each hold a range of it. A file's name is its own, and the index, a table that is written last,
names the files that count: a task that is run again leaves a file that nothing refers to. Nulls
are empty texts, of which the end id remains. An empty table gives no files and an empty index.
"""

from __future__ import annotations

import functools
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_folder, staged
from .chunks import ChunkTable
from .frames import arrow_map
from .store import create, opened
from .textkit import slices, text_buffers

MAGIC = b"SLTDAC01"
SEGMENT = 1 << 20
_BLOCK = 512
#: Text encoded at once, and what a worker's table of chunks may take: more than elsewhere, as a chunk is dear to encode.
SLICE_BYTES = 4 << 20
#: Ids that one read spans at most (or one document), and those between two documents that it may pass over.
READ_IDS = 1 << 18
GAP_IDS = 1 << 12
TABLE_BYTES = 224 << 20


def _padded(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 8)


def pack(ids: np.ndarray) -> bytes:
    """One segment."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        chunk, rest = (rest & np.uint32(255)).astype(np.uint8), rest >> np.uint32(8)
        on = rest > 0
        levels.append((chunk, on))
        if not on.any():
            break
        rest = rest[on]
    out = [struct.pack("<q", len(levels)), np.array([len(c) for c, _ in levels], "<i8").tobytes()]
    for chunk, on in levels:
        bits = np.packbits(on, bitorder="little").tobytes()
        bits = np.frombuffer(bits + b"\0" * (-len(bits) % (_BLOCK // 8)), np.uint8)
        ones = np.bitwise_count(bits.view(np.uint64)).reshape(-1, _BLOCK // 64).sum(axis=1)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<i8")
        out += [_padded(chunk.tobytes()), bits.tobytes(), ranks.tobytes()]
    return b"".join(out)


class Writer:
    """Writes ids, in any portions, to the file ``uri``."""

    def __init__(self, uri: str) -> None:
        self._out, self.count, self._held, self._offsets = create(uri), 0, [], []
        self._n = 0
        self._at = self._put(MAGIC)

    def _put(self, raw: bytes) -> int:
        self._out.write(raw)
        return len(raw)

    def write(self, ids: np.ndarray) -> None:
        self.count += len(ids)
        self._held.append(ids)
        self._n += len(ids)
        if self._n >= SEGMENT:
            held = np.concatenate(self._held)
            whole = len(held) - len(held) % SEGMENT
            for k in range(0, whole, SEGMENT):
                self._segment(held[k : k + SEGMENT])
            self._held, self._n = [held[whole:]], len(held) - whole

    def _segment(self, ids: np.ndarray) -> None:
        self._offsets.append(self._at)
        self._at += self._put(pack(ids))

    def close(self) -> None:
        if self._n:
            self._segment(np.concatenate(self._held))
        self._put(np.array([*self._offsets, self.count, len(self._offsets)], "<i8").tobytes() + MAGIC)
        self._out.close()


class Reader:
    """Random access to the ids of a file."""

    def __init__(self, uri: str) -> None:
        self._in = opened(uri)
        size = self._in.size()
        self.count, segments = struct.unpack("<qq", self._in.read_at(24, size - 24)[:16])
        if self._in.read_at(8, 0) != MAGIC or self._in.read_at(8, size - 8) != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        self._segments = np.frombuffer(self._in.read_at(8 * segments, size - 24 - 8 * segments), "<i8")
        self._levels = functools.lru_cache(maxsize=64)(self._layout)

    def _layout(self, segment: int) -> list[tuple[int, int, int]]:
        """Of each level the places of its chunks, its bitmap and its directory."""
        at = int(self._segments[segment])
        n = struct.unpack("<q", self._in.read_at(8, at))[0]
        counts = np.frombuffer(self._in.read_at(8 * n, at + 8), "<i8").tolist()
        at, out = at + 8 + 8 * n, []
        for c in counts:
            blocks = -(-c // _BLOCK)
            bits = at + c + -c % 8
            ranks = bits + blocks * (_BLOCK // 8)
            out.append((at, bits, ranks))
            at = ranks + 8 * (blocks + 1)
        return out

    def _rank(self, level: tuple[int, int, int], i: int) -> int:
        """The bits set ahead of place i."""
        block, rest = divmod(i, _BLOCK)
        ahead = struct.unpack("<q", self._in.read_at(8, level[2] + 8 * block))[0]
        if not rest:
            return ahead
        raw = int.from_bytes(self._in.read_at(-(-rest // 8), level[1] + block * (_BLOCK // 8)), "little")
        return ahead + (raw & ((1 << rest) - 1)).bit_count()

    def token(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        segment, i = divmod(i, SEGMENT)
        value = 0
        for k, level in enumerate(self._levels(segment)):
            value |= self._in.read_at(1, level[0] + i)[0] << (8 * k)
            if not self._in.read_at(1, level[1] + i // 8)[0] >> (i % 8) & 1:
                break
            i = self._rank(level, i)
        return value

    def tokens(self, start: int, n: int) -> np.ndarray:
        """The n ids from ``start`` on: in each level one run of chunks and of bits is read."""
        out = []
        while n > 0:
            segment, i = divmod(start, SEGMENT)
            k = min(n, SEGMENT - i)
            out.append(self._run(self._levels(segment), i, k))
            start, n = start + k, n - k
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def _run(self, levels: list[tuple[int, int, int]], i: int, n: int) -> np.ndarray:
        value, which = np.zeros(n, np.uint32), np.arange(n)
        for k, level in enumerate(levels):
            if not n:
                break
            value[which] |= np.frombuffer(self._in.read_at(n, level[0] + i), np.uint8).astype(np.uint32) << np.uint32(8 * k)
            first = i // 8
            raw = np.frombuffer(self._in.read_at((i + n + 7) // 8 - first, level[1] + first), np.uint8)
            on = np.unpackbits(raw, bitorder="little")[i - 8 * first :][:n].astype(bool)
            which = which[on]
            if len(which):
                i = self._rank(level, i)
            n = len(which)
        return value


class Encoder:
    """A byte-level BPE of the tokenizers library, each distinct chunk of text encoded once.

    Text is cut at single spaces and line ends between two other characters. The pattern that
    splits text for the merges always starts anew there, so ids on both sides don't depend on
    each other. The ids of many chunks come from one call, told apart by the bytes they stand for.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the threads
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self._bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        added = self.library.get_added_tokens_decoder()
        for token, i in vocabulary.items():  # a byte is a character in this alphabet
            self._bytes[i] = len(token.encode()) if i in added else len(token)
        self.table = ChunkTable(self._segment, TABLE_BYTES)

    def _call(self, texts: list[bytes]) -> list[np.ndarray]:
        got = self.library.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in got] or [np.zeros(0, np.uint32)]

    def _segment(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(chunks), np.uint8)
        # a chunk that starts a text has no space before it, one with odd ends may meet the next: these go alone
        starts = ends - sizes
        after = np.append(_starts_plainly(data), False)[starts + 1]
        joined = ((data[starts] == 0x20) | (data[starts] == 0x0A)) & after & _ends_plainly(data)[ends - 1]
        many, alone = np.flatnonzero(joined), np.flatnonzero(~joined)
        text = b"".join([chunks[i] for i in many.tolist()])
        till = np.cumsum(sizes[many])
        cuts = till[np.flatnonzero(np.diff(till >> 14))].tolist()
        parts = self._call([text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)])
        ids = np.concatenate(parts)
        last = np.append(0, np.searchsorted(np.cumsum(self._bytes[ids]), till) + 1)
        single = self._call([chunks[i] for i in alone.tolist()])
        lengths, begin = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        lengths[many], begin[many] = np.diff(last), last[:-1]
        if len(alone):
            lengths[alone] = [len(x) for x in single]
            begin[alone] = len(ids) + np.cumsum(lengths[alone]) - lengths[alone]
        ids, till = np.concatenate([ids, *single]), np.cumsum(lengths)
        return ids[np.repeat(begin - (till - lengths), lengths) + np.arange(lengths.sum())], lengths

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the rows one after the other and the rows' bounds in them."""
        data, offsets = text_buffers(column)
        n = len(data)
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        cut = np.zeros(n, bool)
        if n > 2:
            gap = (data == 0x20) | (data == 0x0A)
            cut[1:-1] = gap[1:-1] & _ends_plainly(data)[:-2] & _starts_plainly(data)[2:]
            # not over the ends of rows
            cut[heads] = False
            tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
            cut[tails] = False
        cut[heads] = True
        cuts = np.append(np.flatnonzero(cut), n)
        ids, lengths = self.table.ids(data, cuts) if n else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        return ids, np.append(0, np.cumsum(lengths))[np.searchsorted(cuts[:-1], offsets)] if n else np.zeros(len(offsets), np.int64)


def _starts_plainly(data: np.ndarray) -> np.ndarray:
    """Where a character other than white space can be told by its first byte alone."""
    return (data > 0x20) & (data != 0x7F) & ~((data >= 0x80) & ((data < 0xC3) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3)))


def _ends_plainly(data: np.ndarray) -> np.ndarray:
    """Where a character other than white space ends, as far as its last three bytes tell."""
    out = (data > 0x20) & (data != 0x7F)
    wide = data >= 0x80
    before, ahead = np.concatenate([[0], data[:-1]]), np.concatenate([[0, 0], data[:-2]])
    return out & ~(wide & ((before == 0xC2) | (ahead == 0xE1) | (ahead == 0xE2) | (ahead == 0xE3)))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _write(batches: Iterator[pa.RecordBatch], path: str, end_id: int, folder: str) -> Iterator[pa.RecordBatch]:
    own, writer, uri = encoder(path), None, ""
    part = TaskContext.get().partitionId()
    for batch in slices(batches, "text", SLICE_BYTES):
        if writer is None:
            uri = f"{folder}/ids-{part:06d}-{uuid.uuid4().hex}.dac"
            writer = Writer(uri)
        ids, bounds = own.encode(batch.column("text"))
        n = batch.num_rows
        full = np.full(len(ids) + n, end_id, np.uint32)
        inside = np.ones(len(full), bool)
        inside[bounds[1:] + np.arange(n)] = False
        full[inside] = ids
        at = writer.count + bounds + np.arange(n + 1)
        writer.write(full)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(np.full(n, part, np.int64)), pa.array([uri] * n), pa.array(at[:-1]), pa.array(np.diff(at))],
            ["id", "part", "file", "at", "n_tokens"],
        )
    if writer is not None:
        writer.close()


def write_tokens(df: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all texts and return the index: (id, part, file, at, n_tokens), as a staged table."""
    folder = folder or shared_folder(df.sparkSession) + "/tokens"
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    ordered = docs.repartitionByRange("id").sortWithinPartitions("id", "text")
    return staged(arrow_map(ordered, _write, "id long, part long, file string, at long, n_tokens long", tokenizer, end_id, folder), "index")


def starts(index: DataFrame) -> DataFrame:
    """``index`` with start: the ids of all documents before this one, in all files."""
    files = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    # one row a file
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(F.col("file").alias("of_file"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    return index.join(files, F.col("file") == F.col("of_file")).select(*index.columns, (F.col("ahead") + F.col("at")).alias("start"))


def _runs(files: list[str], starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of sorted documents whose ids are read at once."""
    i = 0
    for j in range(1, len(files) + 1):
        if j == len(files) or files[j] != files[i] or starts[j] - ends[j - 1] > GAP_IDS or ends[j] - starts[i] > READ_IDS:
            yield i, j
            i = j


def _read(batches: Iterator[pa.RecordBatch], want: str) -> Iterator[pa.RecordBatch]:
    uri, reader = None, None
    kind = pa.int64() if want == "ids_crc32" else pa.list_(pa.int64())
    for batch in batches:
        files, at = batch.column("file").to_pylist(), batch.column("at").to_numpy()
        ends = at + batch.column("n_tokens").to_numpy()
        for i, j in _runs(files, at, ends):
            if files[i] != uri:
                uri, reader = files[i], Reader(files[i])
            ids = reader.tokens(int(at[i]), int(ends[j - 1] - at[i]))
            own = [ids[a:b] for a, b in zip(at[i:j] - at[i], ends[i:j] - at[i], strict=True)]
            made = [zlib.crc32(x.astype("<u4").tobytes()) if want == "ids_crc32" else x.astype(np.int64) for x in own]
            rows = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(made, kind)], [*batch.schema.names, want])


def _from_files(index: DataFrame, want: str, kind: str) -> DataFrame:
    # documents that lie together are read together, in as many tasks as their ids ask for
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, int((index.agg(F.sum("n_tokens")).first()[0] or 0) // (4 * SEGMENT)))
    near = index.repartition(tasks, "file", F.floor(F.col("at") / (4 * SEGMENT))).sortWithinPartitions("file", "at")
    return arrow_map(near, _read, f"{', '.join(f'{n} {t}' for n, t in index.dtypes)}, {want} {kind}", want)


def read_tokens(index: DataFrame) -> DataFrame:
    """``index``, whole or what is selected of it, with ids as the files have them."""
    return _from_files(index, "ids", "array<long>")


def digest(df: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read back from the files."""
    return _from_files(starts(write_tokens(df, tokenizer, end_id)), "ids_crc32", "long").select(
        F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32"
    )
