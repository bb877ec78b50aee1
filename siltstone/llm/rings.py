"""Candidates of near copies: SimHash fingerprints of many words, found by pigeonring filtering.

The 64 bits of simhash.py tell texts whose sets of runs overlap by 0.8 (3 to 14 differing bits) from
others no better than chance would. Here a fingerprint has ``WORDS`` of 64 bits: the first is the
SimHash of the set of runs, each further one that of the same hashes mixed anew. Two sets of
similarity 0.8 differ in 0.15 of all bits, unlike ones in half of them; ``SHARE`` lies between.

The bits are a ring. By the pigeonring principle two fingerprints that differ in no more than
``SHARE`` of all bits have some start from which the chain keeps within its share at every length.
A candidate must show a chain that begins with equal bits, and of whose next 64 and 128 bits no more
than that share differ. The equal bits are the key by which fingerprints are dealt out, from a start
at every ``step`` bits; the rest of the chain and the sizes of the sets prune within a key.

That a chain begins with equal bits is likely and not certain, and there are many starts: with 12
bits at each of 96, a pair is missed with probability (1 - 0.8485^12)^96, a millionth, at 0.8 and less
above. Sets of up to ``SHORT`` runs, whose bits differ more often (0.19 for four runs against five),
are dealt out along a second ring too, the same bits in another order. Larger tables have longer keys
and more starts (``PLANS``), so that a key brings together about 2^11 unlike texts at most; with the
longest keys a few pairs of 0.8 in a hundred thousand are missed.

What a key brings together is handed on as groups, members that chains join, and never as pairs. A
key under which more than ``BUCKET`` rows meet is not held in memory: it is handed on whole, as one group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .forest import spanning
from .frames import arrow_map, record_batch
from .textkit import mix

WORDS = 18
BITS = 64 * WORDS
#: The part of the bits that may differ, all over the ring and so along a chain.
SHARE = 0.25
SHORT = 24
#: (bits of a key, bits from one start to the next), each for twice the rows of the one before.
PLANS = ((12, 12), (13, 8), (14, 4), (15, 4), (16, 2), (17, 1))
#: The most rows for which the first plan is taken.
ROWS = 1 << 23
#: The most rows that one key may bring together in memory; up to MANY they are compared along with those of other keys.
BUCKET = 1 << 14
MANY = 256

#: Odd multipliers, one for each word.
_FACTORS = np.random.default_rng(42).integers(0, 1 << 64, WORDS, np.uint64) | np.uint64(1)
_LANES = np.uint64(0x0101010101010101)


def fingerprints(hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(rows, WORDS): of rows with ``size`` hashes each; a bit is 1 if set in over half of them, an empty set has zeros."""
    out = np.zeros((len(size), WORDS), np.uint64)
    some = np.flatnonzero(size)
    if not len(some):
        return out
    # ones are counted in the eight bytes of a word at once, in runs too short for a byte to overflow
    runs = -(-size[some] // 255)
    first = np.concatenate([[0], np.cumsum(runs)[:-1]])
    start = (np.cumsum(size) - size)[some]
    heads = np.repeat(start, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
    counted = np.empty((len(heads), 8), np.uint64)
    for w in range(WORDS):
        with np.errstate(over="ignore"):
            h = mix(hashes * _FACTORS[w]) if w else hashes
        for s in range(8):
            counted[:, s] = np.add.reduceat((h >> np.uint64(s)) & _LANES, heads)
        ones = np.add.reduceat(counted.view(np.uint8).reshape(-1, 8, 8), first, axis=0, dtype=np.int64)
        bits = (2 * ones > size[some, None, None]).transpose(0, 2, 1).reshape(-1, 64)
        out[some, w] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _turned(prints: np.ndarray) -> np.ndarray:
    """The same bits in another order: the first of every word, then the second of every word, and so on."""
    bits = np.unpackbits(prints.copy().view(np.uint8), axis=1, bitorder="little").reshape(-1, WORDS, 64)
    return np.packbits(bits.transpose(0, 2, 1).reshape(-1, BITS), axis=1, bitorder="little").view(np.uint64)


def _chain(words: np.ndarray, start: int) -> np.ndarray:
    """64 bits of each ring from ``start`` on; words has a row for each word."""
    q, low = divmod(start % BITS, 64)
    x = words[q] >> np.uint64(low)
    return x | words[(q + 1) % WORDS] << np.uint64(64 - low) if low else x


def _deal(batches: Iterator[pa.RecordBatch], bits: int, step: int) -> Iterator[pa.RecordBatch]:
    """Of rows (rep, n, prints): a row for each start, its key and the 128 bits of the chain behind it."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            batch = whole.slice(at, 2048)
            rep, n = np.asarray(batch.column("rep")), np.asarray(batch.column("n"))
            prints = np.asarray(batch.column("prints").flatten()).view(np.uint64).reshape(-1, WORDS)
            short, out = np.flatnonzero(n <= SHORT), []
            for number, rows, ring in ((0, slice(None), prints), (1, short, _turned(prints[short]))):
                words = ring.T.copy()
                for s in range(0, BITS, step):
                    key = _chain(words, s) & np.uint64((1 << bits) - 1)
                    k = key.astype(np.int32) + ((number * BITS + s) << bits)
                    out.append((k, n[rows], _chain(words, s + bits), _chain(words, s + bits + 64), rep[rows]))
            k, n, a, b, rep = (np.concatenate(x) for x in zip(*out, strict=True))
            yield record_batch(k=k.astype(np.int32), n=n.astype(np.int32), a=a.view(np.int64), b=b.view(np.int64), rep=rep)


def _groups(batches: Iterator[pa.RecordBatch], threshold: float, bucket: int) -> Iterator[pa.RecordBatch]:
    """Of rows (k, n, a, b, rep) sorted by k and rep: (key, rep, n, first), the groups of two and more that chains join under a key."""
    held = [np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.int64)]
    mark: tuple | None = None  # of the bucket that is being handed on for having outgrown the bound

    def made(k, rep, n, first):
        with np.errstate(over="ignore"):
            key = mix(k.astype(np.uint64) * _FACTORS[0] + mix(first.view(np.uint64))).view(np.int64)
        return record_batch(key=key, rep=rep, n=n, first=first)

    def near(n, a, b, i, j):
        hit = np.bitwise_count(a[i] ^ a[j]) <= SHARE * 64
        i, j = (i[hit] if np.ndim(i) else i), j[hit]
        both = np.bitwise_count(a[i] ^ a[j]) + np.bitwise_count(b[i] ^ b[j]) <= SHARE * 128
        both &= np.minimum(n[i], n[j]) / np.maximum(n[i], n[j]) >= threshold
        hit[hit] = both
        return hit

    def settle(k, n, a, b, rep, heads):
        sizes = np.diff(np.append(heads, len(k)))
        room = np.repeat(heads + sizes, sizes) - np.arange(len(k)) - 1
        label, src, dst, lag = np.arange(len(k)), [], [], 1
        i = np.flatnonzero((np.repeat(sizes, sizes) <= MANY) & (room >= 1))
        while len(i):
            at = i[near(n, a, b, i, i + lag)]
            src.append(at)
            dst.append(at + lag)
            lag += 1
            i = i[room[i] >= lag]
        if src:
            moved, to = spanning(np.concatenate(src), np.concatenate(dst), len(k))
            label[moved] = to
        for h in np.flatnonzero(sizes > MANY):
            left = np.arange(heads[h], heads[h] + sizes[h])
            while len(left):  # each member is taken up once, by whom it reaches first
                root, wave = left[0], [left[0]]
                left = left[1:]
                while wave and len(left):
                    hit = near(n, a, b, wave.pop(), left)
                    label[left[hit]] = root
                    wave.extend(left[hit].tolist())
                    left = left[~hit]
        shared = np.bincount(label, minlength=len(k))[label] > 1
        return made(k[shared], rep[shared], n[shared], rep[label[shared]])

    for batch in batches:
        new = [np.asarray(batch.column(c)).astype(np.int64) for c in ("k", "n", "a", "b", "rep")]
        rows = [np.concatenate([h, x.view(h.dtype)]) for h, x in zip(held, new, strict=True)]
        if mark is not None:  # the rest of a bucket that is handed on
            own = int(np.argmin(np.append(rows[0] == mark[0], False)))
            if own:
                yield made(rows[0][:own], rows[4][:own], rows[1][:own], np.full(own, mark[1]))
                rows = [x[own:] for x in rows]
            if len(rows[0]):
                mark = None
        held = [x[:0] for x in rows]
        if not len(rows[0]):
            continue
        k = rows[0]
        heads = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        tail = heads[-1]  # the last bucket may go on in the next batch
        if tail:
            yield settle(*[x[:tail] for x in rows], heads[:-1])
        rows = [x[tail:] for x in rows]
        if len(rows[0]) > bucket:
            mark = (rows[0][0], rows[4][0])
            yield made(rows[0], rows[4], rows[1], np.full(len(rows[0]), mark[1]))
        else:
            held = rows
    if len(held[0]):
        yield settle(*held, np.array([0]))


def groups(classes: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(key, rep, n, first): the members ``rep`` of candidate groups of classes (rep, n, prints), each group with its smallest member."""
    if threshold < 0.8:
        raise ValueError("the ring is laid out for similarities of 0.8 and more")
    known = classes.filter("rep is not null and n > 0").select("rep", "n", "prints")
    bits, step = PLANS[min(len(PLANS) - 1, math.ceil(math.log2(max(1.0, known.count() / ROWS))))]
    dealt = arrow_map(known, _deal, "k int, n int, a long, b long, rep long", bits, step)
    dealt = dealt.repartition("k").sortWithinPartitions("k", "rep")
    return arrow_map(dealt, _groups, "key long, rep long, n long, first long", threshold, BUCKET)
