"""SimHash near-duplicates, found by pigeonring filtering.

A fingerprint has 64 bits, laid out as a ring of three segments. With at most two differing bits
in all, some chain that starts at one of the segments keeps within its share at every length: none
in its first segment, one in the first two, two in all three. Such a chain is what a candidate must
show. The first two links become an equality: segment i is equal, and of the two halves of segment
i + 1 (one bit may differ in it) one is equal. So each fingerprint is dealt out six times, by keys
of about 32 bits; within a key the chain conditions prune, and the full Hamming distance decides.

Copies are one row from the start (a fingerprint's class, with its smallest id). A key under which
more fingerprints meet than ``BUCKET`` is not compared as a whole: its members go on by longer keys,
one for each third of the bits still free, of which one third must be equal again. After two such
steps the free bits are too few for a bucket above the bound, so every bucket fits in memory, and
each sends out a spanning forest of its links, never its pairs.

Nulls and texts without words have the fingerprint zero and link like any other; texts of one or
two words are one shingle. Rows with a null id get a fingerprint and the component of their class.
Repeated rows are copies. An empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import staged
from . import nearcopies
from .frames import arrow_map, once, text_key, without_rows
from .textkit import Words, lower_ascii, slices, text_buffers, xxh64

#: The most fingerprints that one key may bring together in memory.
BUCKET = 1 << 14
#: Up to this many they are compared along with those of other keys.
SMALL = 48
DISTANCE = 2
#: (lowest bit, width) of the three segments of the ring, and of each segment's halves.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def _mask(low: int, width: int) -> int:
    return ((1 << width) - 1) << low


def _chains() -> list[int]:
    """The bits that are equal for each way a chain can begin: a segment and half of the next."""
    out = []
    for i in range(3):
        low, width = SEGMENTS[(i + 1) % 3]
        half = width // 2
        for part in (_mask(low, half), _mask(low + half, width - half)):
            out.append(_mask(*SEGMENTS[i]) | part)
    return out


def _thirds(equal: int) -> list[int]:
    """``equal`` with each third of the bits that it leaves free."""
    free = [b for b in range(64) if not equal >> b & 1]
    cut = [len(free) * k // 3 for k in range(4)]
    return [equal | sum(1 << b for b in free[cut[k] : cut[k + 1]]) for k in range(3)]


#: Keys by step: six of about 32 equal bits, then 18 of about 43, then 54 of 50 or more.
KEYS: list[list[int]] = [_chains()]
for _ in range(2):
    KEYS.append([m for equal in KEYS[-1] for m in _thirds(equal)])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        data, offsets = text_buffers(batch.column("text"))
        words = Words(lower_ascii(data), offsets)
        counts, first = words.counts, words.bounds[:-1]
        n = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
        at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        last = np.minimum(at + shingle, np.repeat(words.bounds[1:], n)) - 1
        hashes = xxh64(words.data, words.starts[at], words.ends[last], seed)
        out = np.zeros(len(n), np.uint64)
        ends = np.cumsum(n)
        for row in np.flatnonzero(n):
            own = hashes[ends[row] - n[row] : ends[row]]
            ones = np.zeros(64, np.int64)
            for k in range(0, len(own), 1 << 16):
                bits = np.unpackbits(own[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones += bits.sum(axis=0, dtype=np.int64)
            out[row] = np.packbits(2 * ones > n[row], bitorder="little").view(np.uint64)[0]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(out.view(np.int64))], ["id", "key", "fp"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, key, fp): the fingerprint of every row as a signed 64-bit integer; key tells texts of one id apart."""
    text = F.col(f"`{text_col}`").cast("string")
    source = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_key(text).alias("key"), text.alias("text"))
    return arrow_map(source, _fingerprints, "id long, key long, fp long", shingle, seed)


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where a and b link. The ring is looked at first: some chain must keep within its share."""
    x = a ^ b
    d = [np.bitwise_count(x & np.uint64(_mask(*s))) for s in SEGMENTS]
    ring = np.zeros(len(x), bool)
    for i in range(3):
        ring |= (d[i] == 0) & (d[(i + 1) % 3] <= 1)
    return ring & (np.bitwise_count(x) <= DISTANCE)


def _forest(fp: np.ndarray, rep: np.ndarray) -> tuple[list, list]:
    """A spanning forest of one bucket's links: each member is taken up once, by whom it reaches first."""
    left, a, b = np.arange(len(fp)), [], []
    while len(left):
        wave = [left[0]]
        left = left[1:]
        while wave and len(left):
            at = wave.pop()
            hit = _near(fp[left], fp[at])
            if hit.any():
                got = left[hit]
                a.append(np.full(len(got), rep[at]))
                b.append(rep[got])
                wave.extend(got.tolist())
                left = left[~hit]
    return a, b


def _links(batches: Iterator[pa.RecordBatch], last: bool, bucket: int) -> Iterator[pa.RecordBatch]:
    """Of rows (k, equal, fp, rep) sorted by k and equal: links (src, dst), or members (src, fp) of full buckets."""
    held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
    mark: tuple | None = None  # of the bucket that is being passed on for having outgrown the bound

    def made(src, dst, fp, k):
        fp = np.full(len(src), 0, np.int64) if fp is None else fp
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (src, dst, fp, np.full(len(src), k))], ["src", "dst", "fp", "k"])

    def settle(k, fp, rep, heads):
        sizes = np.diff(np.append(heads, len(k)))
        sized = np.repeat(sizes, sizes)
        small = sized <= SMALL
        src, dst = [], []
        for lag in range(1, int(min(sizes.max(initial=1), SMALL))):
            i = np.flatnonzero(small[lag:] & (np.repeat(np.arange(len(sizes)), sizes)[lag:] == np.repeat(np.arange(len(sizes)), sizes)[:-lag]))
            i = i[_near(fp[i], fp[i + lag])]
            src.append(rep[i])
            dst.append(rep[i + lag])
        for h in np.flatnonzero(sizes > SMALL):
            own = slice(heads[h], heads[h] + sizes[h])
            a, b = _forest(fp[own], rep[own])
            src += a
            dst += b
        if src:
            yield made(np.concatenate(src), np.concatenate(dst), None, -1)

    def keys(k, value):
        return np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (value[1:] != value[:-1])]))

    masks = np.array(KEYS[0] + KEYS[1] + KEYS[2], np.uint64)
    for batch in batches:
        new = [np.asarray(batch.column(i)) for i in range(3)]
        k, fp, rep = (np.concatenate([h, x]) for h, x in zip(held, (new[0], new[1].astype(np.int64), new[2]), strict=True))
        value = fp.view(np.uint64) & masks[k]
        if mark is not None:  # the rest of a bucket that is passed on
            own = int(np.argmin(np.append((k == mark[0]) & (value == mark[1]), False)))
            if own:
                yield made(rep[:own], rep[:own], fp[:own], mark[0])
                k, fp, rep, value = k[own:], fp[own:], rep[own:], value[own:]
            if len(k):
                mark = None
        held = [k[:0], fp[:0], rep[:0]]
        if not len(k):
            continue
        heads = keys(k, value)
        tail = heads[-1]  # the last bucket may go on in the next batch
        if tail:
            yield from settle(k[:tail], fp[:tail].view(np.uint64), rep[:tail], heads[:-1])
        k, fp, rep, value = k[tail:], fp[tail:], rep[tail:], value[tail:]
        if len(k) > bucket and not last:
            mark = (k[0], value[0])
            yield made(rep, rep, fp, k[0])
        else:
            held = [k, fp, rep]
    if len(held[0]):
        yield from settle(held[0], held[1].view(np.uint64), held[2], np.array([0]))


def _deal(df: DataFrame, masks: list[int], base: int, under: str | None) -> DataFrame:
    """A row for each key of ``masks`` (numbered from base), sorted by key within its partition."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    if under is None:
        which = F.array(*[F.struct(F.lit(base + i).alias("k"), F.lit(m).cast("long").alias("m")) for i, m in enumerate(signed)])
    else:  # the three that carry on the key a bucket had
        all_of = F.array(*[F.struct(F.lit(base + i).alias("k"), F.lit(m).cast("long").alias("m")) for i, m in enumerate(signed)])
        which = F.slice(all_of, F.col(under) * 3 + 1, 3)
    rows = df.select(F.explode(which).alias("w"), "fp", "rep").select(
        F.col("w.k").cast("int").alias("k"), "fp", "rep", F.col("fp").bitwiseAND(F.col("w.m")).alias("equal")
    )
    return rows.repartition("k", "equal").sortWithinPartitions("k", "equal").select("k", "fp", "rep")


def links(classes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(src, dst) between the representatives ``rep`` of fingerprint classes (fp, rep); their components are those of all links."""
    dealt, found, base = _deal(classes, KEYS[0], 0, None), [], 0
    for step in range(3):
        last = step == 2
        out = staged(arrow_map(dealt, _links, "src long, dst long, fp long, k long", last, bucket), f"links{step}")
        found.append(out.filter("k < 0").select("src", "dst"))
        more = out.filter("k >= 0")
        if last or more.isEmpty():
            break
        more = more.select(F.col("fp"), F.col("src").alias("rep"), (F.col("k") - base).alias("under"))
        base += len(KEYS[step])
        dealt = _deal(more, KEYS[step + 1], base, "under")
    edges = found[0]
    for more in found[1:]:
        edges = edges.union(more)
    return edges


def _components(prints: DataFrame) -> DataFrame:
    """The staged ``prints`` (id, key, fp) with component_id."""
    classes = staged(prints.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    parts = connected_components(links(classes.filter("rep is not null")))
    named = classes.join(parts, F.col("rep") == F.col("node"), "left").select(
        F.col("fp").alias("class_fp"), F.coalesce("component", "rep").alias("component_id")
    )
    return prints.join(named, F.col("fp") == F.col("class_fp")).drop("class_fp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fingerprint, component_id, kept) for every row of ``df``.

    Fingerprints link at DISTANCE or fewer differing bits; component_id is the smallest id that can
    be reached by links, the row's own included; kept marks the row whose id that is.
    """
    found = _components(staged(fingerprints(df, id_col, text_col, shingle), "fingerprints"))
    return found.select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        (F.col("id") == F.col("component_id")).alias("kept"),
    )


def one_of_each(df: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` with one row of each group left; ``rows`` (id, key, component_id) has a row for each of ``df``.

    The one left has the smallest id of its group, and of several texts under that id the one with
    the smallest key; of rows equal in both one stays. Rows without an id stay.
    """
    counted = staged(rows.filter("id is not null").groupBy("component_id", "id", "key").agg(F.count("*").alias("n")), "rows")
    left = counted.groupBy("component_id").agg(F.min(F.struct("id", "key")).alias("left"))
    placed = counted.join(left, "component_id").withColumn("stays", F.struct("id", "key") == F.col("left"))
    placed = staged(placed.select(F.col("id").alias("gone_id"), F.col("key").alias("gone_key"), "stays", "n"), "decided")
    out = without_rows(df, placed.filter("not stays").select("gone_id", "gone_key"), id_col, text_col)
    return once(out, placed.filter("stays and n > 1").select("gone_id", "gone_key"), id_col, text_col)


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, similarity: float | None = None) -> DataFrame:
    """``df`` with one row of each group left, decided by row as in one_of_each().

    Groups are those of fingerprints, or with ``similarity`` those of texts whose sets of runs of
    ``shingle`` words overlap by so much: 64 bits do not tell such pairs from others (at 0.8 they
    lie 3 to 14 bits apart), so rings.py proposes them by pigeonring over wider fingerprints and
    nearcopies.py checks the whole sets.
    """
    if similarity is not None:
        rows = nearcopies.components(df, id_col, text_col, shingle, similarity)
    else:
        rows = _components(staged(fingerprints(df, id_col, text_col, shingle), "fingerprints"))
    return one_of_each(df, rows, id_col, text_col)
