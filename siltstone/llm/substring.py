"""Substring duplicates by relative Lempel-Ziv parsing against the blocks of every document.

A window is ``WINDOW`` consecutive words of a document. Each document is cut into reference blocks
by its content alone: every window is owned by the run of ``GRAM`` words in it whose hash is
smallest (the block's anchor), and a block is what the windows of one anchor cover. Equal windows
own equal anchors wherever they stand, so a factor of WINDOW words or more can only come from the
reference blocks of the anchors in it, and these are what the index brings together.

1. Index: (anchor, block) -> smallest document that has it, for every block of every document. A
   block that an earlier document has whole is one factor.
2. Any other block is parsed greedily against the blocks that earlier documents have for its anchor.
   Laid against each other at the anchor, every reference is extended word by word to both sides as
   far as it agrees; from the place that the parse has reached, the reference that goes furthest
   gives the factor. A factor of WINDOW words or more becomes a span. The parse goes on at its
   boundary: with the first window that crosses it, which may lie in another reference, and word by
   word from there where it has no factor.
3. A document's covered words are those of its spans.

An anchor with more than ``REFERENCES`` different blocks is not held in one task. Of the words that a
window has besides the anchor either the half behind it or more than the half ahead of it are its
neighbours there, so such blocks are dealt out by these two longer anchors, and parsed against the
blocks that share one; where these are too many still, by longer ones again, until an anchor is a
whole window, whose smallest document is a sum.

Words, anchors, blocks and windows are known by 64-bit hashes; a block or window counts as equal if its
anchor is as well. A doc_id shared by several rows counts as one document. Rows with a null id are
neither indexed nor cut. Null and empty texts, and texts under ``WINDOW`` words, keep all they have.
An empty table gives an empty result. Input columns named like an output are replaced by
dedup_substrings(); strip_substrings() has no outputs of its own and keeps them all.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import staged
from .frames import arrow_map, without
from .textkit import Rolling, Words, mix, slices, sliding_min, text_buffers, xxh64

WINDOW = 50
GRAM = 8
#: Different blocks of one anchor that are parsed against each other in one task.
REFERENCES = 256

#: A run's rank among the runs of a window: this many bits of its hash, then its place (leftmost first).
_PLACE_BITS = 30


class Blocks:
    """The windows of some rows, and the blocks that own them.

    words; row, start: of each window its row and its first word; block: of each window its block;
    owner, anchor, content: of each block its row and its hashes.
    """

    def __init__(self, column: pa.Array, window: int, gram: int) -> None:
        self.words = words = Words(*text_buffers(column))
        self.window = window
        counts = words.counts
        n = np.maximum(counts - window + 1, 0)
        self.row = np.repeat(np.arange(len(counts)), n)
        self.start = np.repeat(words.bounds[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        if not len(self.start):
            self.block = self.owner = np.zeros(0, np.int64)
            self.anchor = self.content = np.zeros(0, np.uint64)
            self.head = self.size = self.offset = self.before = np.zeros(0, np.int64)
            return
        self.hashes = xxh64(words.data, words.starts, words.ends)
        self.rolling = Rolling(self.hashes)
        at = np.arange(len(words.starts) - gram + 1)
        grams = self.rolling.of(at, at + gram)
        ranked = (grams >> np.uint64(_PLACE_BITS)) << np.uint64(_PLACE_BITS) | at.astype(np.uint64)
        place = sliding_min(ranked, window - gram + 1)[self.start] & np.uint64((1 << _PLACE_BITS) - 1)
        place = place.astype(np.int64)
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (self.row[1:] != self.row[:-1])])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(place)) - 1
        self.block = np.cumsum(new) - 1
        self.owner = self.row[head]
        # of each block its first word, its windows and the words ahead of its anchor; of each window the words ahead of its anchor
        self.head, self.size = self.start[head], tail - head + 1
        self.offset = place[head] - self.head
        self.before = place - self.start
        self.anchor = grams[place[head]]
        inside = self.rolling.of(self.start[head], self.start[tail] + window)
        with np.errstate(over="ignore"):  # where the anchor stands in the block is part of what it is
            self.content = mix(inside + mix((place[head] - self.start[head]).astype(np.uint64)))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _index(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        b = Blocks(batch.column("text"), window, gram)
        ids = np.asarray(batch.column("id"))[b.owner]
        yield pa.RecordBatch.from_arrays([_signed(b.anchor), _signed(b.content), pa.array(ids)], ["anchor", "content", "id"])


def _rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the rows' bounds in them; null counts as empty."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    values = column.flatten()
    return np.asarray(values).view(np.uint64), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _among(rows: np.ndarray, values: np.ndarray, column: pa.Array) -> np.ndarray:
    """Whether values[i] is in the list that ``column`` has for rows[i]; rows must not fall."""
    listed, bounds = _rows_of(column)
    out = np.zeros(len(values), bool)
    edges = np.searchsorted(rows, np.arange(len(column) + 1))
    for r in np.flatnonzero((np.diff(bounds) > 0) & (np.diff(edges) > 0)):
        own = slice(edges[r], edges[r + 1])
        out[own] = np.isin(values[own], listed[bounds[r] : bounds[r + 1]])
    return out


def _reach(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many leading words of ``own`` each of ``others`` has."""
    out = np.empty(len(others), np.int64)
    for k, x in enumerate(others):
        n = min(len(own), len(x))
        differ = own[:n] != x[:n]
        at = int(differ.argmax()) if n else 0
        out[k] = at if n and differ[at] else n
    return out


def factors(own: np.ndarray, offset: int, references: list[tuple[np.ndarray, int]], window: int) -> list[tuple[int, int]]:
    """The greedy parse of a block: [from, to) of its factors of ``window`` words or more.

    own: the words' hashes; offset: how many stand ahead of the anchor; references: the same of blocks with that anchor.
    """
    ahead = _reach(own[offset:], [w[o:] for w, o in references])
    back = _reach(own[:offset][::-1], [w[:o][::-1] for w, o in references])
    furthest = np.full(offset + 1, -offset)  # by the words that must agree ahead of the anchor; none reaches that far yet
    np.maximum.at(furthest, back, ahead)
    furthest = np.maximum.accumulate(furthest[::-1])[::-1].tolist()
    out, at = [], 0
    while at <= offset and at + window <= len(own):
        end = offset + furthest[offset - at]
        if end - at >= window:
            out.append((at, end))
            at = end - window + 1  # the first window across the boundary
        else:
            at += 1
    return out


def _mask(spans: list[tuple[int, int]], offset: int, window: int) -> int:
    """Bit b: the window with b words ahead of its anchor lies in a span."""
    out = 0
    for a, b in spans:
        low, high = offset - (b - window), offset - a
        out |= ((1 << (high - low + 1)) - 1) << low
    return out


def _open_blocks(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(anchor, content, id, offset, words) of the blocks that are to be parsed."""
    for batch in slices(batches, "text"):
        b = Blocks(batch.column("text"), window, gram)
        which = np.flatnonzero(_among(b.owner, b.content, batch.column("open")))
        if not len(which):
            continue
        which = which[np.unique(np.stack([b.owner[which], b.content[which].view(np.int64)]), axis=1, return_index=True)[1]]
        ids = np.asarray(batch.column("id"))[b.owner[which]]
        raw = [b.hashes[b.head[k] : b.head[k] + b.size[k] + window - 1].tobytes() for k in which.tolist()]
        yield pa.RecordBatch.from_arrays(
            [_signed(b.anchor[which]), _signed(b.content[which]), pa.array(ids), pa.array(b.offset[which]), pa.array(raw, pa.binary())], ["anchor", "content", "id", "offset", "words"]
        )


def _parse(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, content, id, offset, lo, words) sorted by key and id, which agree at lo: of each block that has factors (id, content, mask)."""
    key, references = None, []
    for batch in batches:
        got = []
        for own, content, i, offset, lo, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != key:
                key, references = own, []
            words = np.frombuffer(raw, "<u8")
            earlier = [(w, o) for w, o, j in references if j < i]
            if earlier and (mask := _mask(factors(words, lo, earlier, window), offset, window)):
                got.append((i, content, mask))
            references.append((words, lo, i))
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], ["id", "content", "mask"])


def _longer(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows (content, id, offset, lo, hi, words), whose words [lo, hi) are an anchor, under the two longer anchors that a window may hold."""
    for batch in batches:
        out = []
        for content, i, offset, lo, hi, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            behind = (window - hi + lo + 1) // 2
            ahead = window - hi + lo - behind + 1
            for a, b in ((lo, hi + behind), (lo - ahead, hi)):
                if a >= 0 and 8 * b <= len(raw):
                    key = hashlib.blake2b(raw[8 * a : 8 * b], digest_size=8).digest()
                    out.append((int.from_bytes(key, "little", signed=True), content, i, offset, a, b, raw))
        if out:
            kinds = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["key", *batch.schema.names])


def _masks(column: pa.Array, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For values[i] the mask that the list of structs (content, mask) of rows[i] has for it, or 0; rows must not fall."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    flat = column.flatten()
    content, mask = (np.asarray(flat.field(k)) for k in (0, 1))
    out = np.zeros(len(values), np.int64)
    edges = np.searchsorted(rows, np.arange(len(column) + 1))
    for r in np.flatnonzero((np.diff(bounds) > 0) & (np.diff(edges) > 0)):
        own, listed = slice(edges[r], edges[r + 1]), content[bounds[r] : bounds[r + 1]].view(np.uint64)
        order = np.argsort(listed)
        at = np.minimum(np.searchsorted(listed, values[own], sorter=order), len(listed) - 1)
        hit = listed[order[at]] == values[own]
        out[own] = np.where(hit, mask[bounds[r] : bounds[r + 1]][order[at]], 0)
    return out


def _cut(batches: Iterator[pa.RecordBatch], names: list[str], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "siltstone_text"):
        texts = batch.column("siltstone_text")
        b = Blocks(texts, window, gram)
        words, n = b.words, len(b.words.starts)
        gone = np.zeros(n, bool)
        if len(b.start):
            settled = _among(b.owner, b.content, batch.column("siltstone_blocks"))[b.block]
            settled |= (_masks(batch.column("siltstone_masks"), b.owner, b.content)[b.block] >> b.before & 1) > 0
            step = np.zeros(n + 1, np.int64)
            np.add.at(step, b.start[settled], 1)
            np.add.at(step, b.start[settled] + window, -1)
            gone = np.cumsum(step[:-1]) > 0
        removed = np.concatenate([[0], np.cumsum(gone)])[words.bounds]
        kept: list[str] = []
        raw = words.data.tobytes()
        flips = np.flatnonzero(gone[1:] != gone[:-1]) + 1
        for r in range(batch.num_rows):
            lo, hi = words.bounds[r], words.bounds[r + 1]
            cuts = [lo, *flips[np.searchsorted(flips, lo, "right") : np.searchsorted(flips, hi)].tolist(), hi]
            runs = [raw[words.starts[i] : words.ends[j - 1]] for i, j in zip(cuts, cuts[1:], strict=False) if i < j and not gone[i]]
            kept.append(b" ".join(runs).decode("utf-8", "replace"))
        made = {
            "siltstone_n_words": pa.array(words.counts.astype(np.int64)),
            "siltstone_n_removed": pa.array(np.diff(removed).astype(np.int64)),
            "siltstone_kept": pa.array(kept, pa.string()),
        }
        yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in names], names)


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, references: int = REFERENCES) -> DataFrame:
    """(id, blocks, masks): of each document with factors long enough, the blocks that are one factor, and what factors cover of others."""
    if window - gram >= 63:
        raise ValueError("a block's windows are told by the bits of one integer: window - gram must be less than 63")
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    docs = docs.filter("id is not null")
    index = staged(arrow_map(docs, _index, "anchor long, content long, id long", window, gram).distinct(), "index")
    first = index.groupBy("anchor", "content").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    # an anchor in one document is of no use; one with one content has no block but whole factors
    kinds = first.groupBy("anchor").agg(F.count("*").alias("contents"), F.min("first").alias("a"), F.max("last").alias("z")).filter("a < z")
    blocks = index.join(first.drop("last").join(kinds.select("anchor", "contents"), "anchor"), ["anchor", "content"])
    own = (F.col("id") == F.col("first")) & (F.col("contents") > 1)
    blocks = staged(
        blocks.groupBy("id").agg(
            F.collect_set(F.when(F.col("id") > F.col("first"), F.col("content"))).alias("blocks"),
            F.collect_set(F.when(own & (F.col("contents") <= references), F.col("content"))).alias("open"),
            F.collect_set(F.when(own & (F.col("contents") > references), F.col("content"))).alias("hot"),
        ),
        "blocks",
    )
    block = "anchor long, content long, id long, offset long, words binary"
    asked = lambda c: docs.join(blocks.filter(F.size(c) > 0).select("id", F.col(c).alias("open")), "id")
    found = [_parsed(arrow_map(asked("open"), _open_blocks, block, window, gram).select(F.col("anchor").alias("key"), "content", "id", "offset", F.col("offset").alias("lo"), "words"), window)]
    hot = staged(arrow_map(asked("hot"), _open_blocks, block, window, gram), "hot")
    row = ["content", "id", "offset", "lo", "hi", "words"]
    hot = hot.select("content", "id", "offset", F.col("offset").alias("lo"), (F.col("offset") + gram).alias("hi"), "words")
    kind = "key long, content long, id long, offset long, lo long, hi long, words binary"
    while not hot.isEmpty():
        dealt = staged(arrow_map(hot.select(*row), _longer, kind, window), "longer")
        sizes = dealt.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").drop("last")
        dealt = dealt.join(sizes, "key")
        found.append(_parsed(dealt.filter(F.col("n") <= references).select("key", "content", "id", "offset", "lo", "words"), window))
        hot = dealt.filter(F.col("n") > references)
        whole = F.col("hi") - F.col("lo") >= window
        found.append(hot.filter(whole & (F.col("id") > F.col("first"))).select("id", "content", F.expr("shiftleft(1L, cast(offset - lo AS int))").alias("mask")))
        hot = hot.filter(~whole)
    masks = functools.reduce(DataFrame.union, found).groupBy("id", "content").agg(F.bit_or("mask").alias("mask"))
    masks = masks.groupBy("id").agg(F.collect_list(F.struct("content", "mask")).alias("masks"))
    return blocks.select("id", "blocks").join(masks, "id", "full")


def _parsed(rows: DataFrame, window: int) -> DataFrame:
    return arrow_map(rows.repartition("key").sortWithinPartitions("key", "id"), _parse, "id long, content long, mask long", window)


def _stripped(df: DataFrame, id_col: str, text_col: str, window: int, gram: int, references: int) -> DataFrame:
    """``df`` with siltstone_n_words, siltstone_n_removed and siltstone_kept."""
    found = spans(df, id_col, text_col, window, gram, references)
    joined = df.join(
        found.select(F.col("id").alias("siltstone_id"), F.col("blocks").alias("siltstone_blocks"), F.col("masks").alias("siltstone_masks")),
        F.col(f"`{id_col}`").cast("long") == F.col("siltstone_id"),
        "left",
    ).withColumn("siltstone_text", F.col(f"`{text_col}`").cast("string"))
    made = [("siltstone_n_words", T.LongType()), ("siltstone_n_removed", T.LongType()), ("siltstone_kept", T.StringType())]
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in made]])
    return arrow_map(joined.drop("siltstone_id"), _cut, schema, [*df.columns, *[n for n, _ in made]], window, gram)


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, references: int = REFERENCES) -> DataFrame:
    """``df`` with n_words, n_removed and kept_text, the words that no window of an earlier document covers."""
    out = _stripped(df, id_col, text_col, window, gram, references)
    return out.select(
        *[F.col(f"`{c}`") for c in without(df, "n_words", "n_removed", "kept_text").columns],
        F.col("siltstone_n_words").alias("n_words"), F.col("siltstone_n_removed").alias("n_removed"), F.col("siltstone_kept").alias("kept_text"),
    )


def strip_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """``df``, all its columns, with the words gone that dedup_substrings() takes; texts that lose none stay as they are, ``chars_col`` follows its text."""
    out = _stripped(df, id_col, text_col, WINDOW, GRAM, REFERENCES)
    cut = F.col("siltstone_n_removed") > 0
    put = {text_col: F.col("siltstone_kept")} | ({chars_col: F.length("siltstone_kept").cast(df.schema[chars_col].dataType)} if chars_col else {})
    return out.select(*[F.when(cut, put[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in put else F.col(f"`{c}`") for c in df.columns])


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row."""
    return dedup_substrings(df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), id_col, text_col).select(
        F.col(f"`{id_col}`"), "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS s, ws FROM d WHERE len(ws) >= 50),
k AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 49], ' ')) AS key FROM w),
f AS (SELECT key, min(doc_id) AS first FROM k GROUP BY key),
c AS (SELECT DISTINCT k.doc_id, k.s + o.range AS pos FROM k JOIN f USING (key), range(0, 50) o WHERE f.first < k.doc_id),
e AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d),
m AS (SELECT e.doc_id, e.word, e.pos, c.pos IS NOT NULL AS gone FROM e LEFT JOIN c ON c.doc_id = e.doc_id AND c.pos = e.pos),
r AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(r.n_words, 0)::BIGINT AS n_words, coalesce(r.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
