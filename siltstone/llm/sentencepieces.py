"""SentencePiece encoding and decoding with a table of distinct chunks.

Where no piece holds a whitespace marker after another character, merges never cross from a
character to a marker that follows it. A text is then cut before every run of markers, each distinct
marked word is segmented once, by the library, and its ids take its places in the texts. A model with
other pieces, or another normaliser than the identity, is given whole texts instead.

Null counts as an empty text: its ids are the begin and end ids alone, decoded to nothing. Markers
(U+2581) in a text are spaces to the library and here. Repeated rows give equal rows; other columns
are passed on by encode() unless they are named like an output; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import ChunkTable
from .frames import arrow_map, without
from .textkit import slices, text_buffers

MARK = "▁"


class Encoder:
    def __init__(self, model: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        # what the library makes of a text that tries its normaliser
        tried = self.library.normalize("a  \tbÅＡ ") == f"{MARK}a{MARK}{MARK}\tbÅＡ{MARK}"
        self.by_chunk = tried and not any(MARK in p.lstrip(MARK) for p in pieces)
        self.table = ChunkTable(self._segment)

    def _segment(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # the library puts the first marker back
        ids = self.library.encode([c[1:].decode() for c in chunks], num_threads=1)
        alone = [i for i, c in enumerate(chunks) if c == b" "]
        for i in alone:  # a marker and nothing else
            ids[i] = [self.library.piece_to_id(MARK)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((x for one in ids for x in one), np.uint32, int(lengths.sum())), lengths

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the rows one after the other, with begin and end ids, and the rows' bounds."""
        n = len(column)
        column = column.fill_null("").cast(pa.large_string())
        begin, end = self.library.bos_id(), self.library.eos_id()
        if not self.by_chunk:
            ids = self.library.encode(column.to_pylist(), num_threads=1, add_bos=True, add_eos=True)
            lengths = np.fromiter(map(len, ids), np.int64, n)
            return np.fromiter((x for one in ids for x in one), np.uint32, int(lengths.sum())), np.append(0, np.cumsum(lengths))
        if pc.any(pc.match_substring(column, MARK)).as_py():
            column = pc.replace_substring(column, MARK, " ")
        full = pc.not_equal(pc.binary_length(column), 0)
        column = pc.if_else(full, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())), column)
        data, offsets = text_buffers(column)
        space = data == 0x20
        first = space.copy()
        if len(data):
            first[1:] &= ~space[:-1]
            first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        cuts = np.append(np.flatnonzero(first), len(data))
        ids, lengths = self.table.ids(data, cuts)
        ends = np.append(0, np.cumsum(lengths))[np.searchsorted(cuts[:-1], offsets)]
        bounds = ends + 2 * np.arange(n + 1)
        out = np.empty(bounds[-1], np.uint32)
        inside = np.ones(len(out), bool)
        inside[bounds[:-1]] = inside[bounds[1:] - 1] = False
        out[bounds[:-1]], out[bounds[1:] - 1] = begin, end
        out[inside] = ids
        return out, bounds


@functools.lru_cache(maxsize=2)
def encoder(model: str) -> Encoder:
    return Encoder(model)


def _encode(batches: Iterator[pa.RecordBatch], names: list[str], text: str, model: str, decode: bool) -> Iterator[pa.RecordBatch]:
    try:
        for batch in slices(batches, text):
            ids, bounds = encoder(model).encode(batch.column(text).cast(pa.string()))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
            made = {"ids": lists}
            if decode:
                made["decoded"] = pa.array(_decoded(lists, model), pa.string())
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in names], names)
    finally:
        encoder(model).table.clear()


def _decoded(lists: pa.Array, model: str) -> list[str]:
    library = encoder(model).library
    return [library.decode(x) if x else "" for x in lists.to_pylist()]


def encode(df: DataFrame, model: str, text_col: str = "text", decode: bool = False) -> DataFrame:
    """``df`` with ids, array<int> with begin and end ids, and on demand decoded, what these give again."""
    made = [T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.StringType())] * decode
    base = without(df, *[f.name for f in made])
    source = base.withColumn("siltstone_text", F.col(f"`{text_col}`").cast("string")) if text_col in base.columns else df.select(
        *base.columns, F.col(f"`{text_col}`").cast("string").alias("siltstone_text")
    )
    names = [*base.columns, *[f.name for f in made]]
    return arrow_map(source, _encode, T.StructType([*base.schema.fields, *made]), names, "siltstone_text", model, decode)


def _decode(batches: Iterator[pa.RecordBatch], names: list[str], model: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = {"decoded": pa.array(_decoded(batch.column("siltstone_ids"), model), pa.string())}
        yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in names], names)


def decode(df: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with decoded, the text of ``ids_col``; null ids give an empty text."""
    base = without(df, "decoded")
    source = df.select(*[F.col(f"`{c}`") for c in base.columns], F.col(f"`{ids_col}`").cast("array<int>").alias("siltstone_ids"))
    schema = T.StructType([*base.schema.fields, T.StructField("decoded", T.StringType())])
    return arrow_map(source, _decode, schema, [*base.columns, "decoded"], model)


def _digest(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    import hashlib

    own = encoder(model)
    try:
        for batch in slices(batches, "text"):
            ids, bounds = own.encode(batch.column("text"))
            raw = memoryview(ids.astype("<u4").tobytes())
            shas, texts = [], []
            for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
                shas.append(hashlib.sha256(raw[4 * a : 4 * b]).hexdigest())
                texts.append(hashlib.sha256(own.library.decode(ids[a:b].tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.diff(bounds)), pa.array(shas), pa.array(texts)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )
    finally:  # the table is a task's, so that idle workers hold none
        own.table.clear()


def digest(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row: what encode() and decode() give, hashed in place."""
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = arrow_map(source, _digest, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", model)
    return out.withColumnRenamed("id", id_col)
