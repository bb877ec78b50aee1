"""Near copies by runs of words: SimHash candidates by pigeonring, each checked on the whole sets.

Two texts link if the sets of their runs of five words (lower case in ASCII) have a Jaccard
similarity of 0.8 or more. Fingerprints of the sets propose groups along chains of their ring
(rings.py, which says how rarely a pair is missed). What is proposed is checked on the full sets of
64-bit hashes, so no link is estimated.

Texts with equal sets are one row from the start (a class, with its smallest id). Each member of
proposed groups is checked against one of their first members, that which it shares most groups with,
in as many pairs as there are members. Where a group still holds more than one component, its members
meet in tiles: two blocks of bounded size, whose sets one task holds and compares, so that no proposed
pair is left out and none becomes a row. Pairs within a component would change nothing: a block of a
large component is one row of each group it is in, and blocks of one and the same do not meet.

Nulls and texts without words have the empty set and are copies of each other; a text of fewer than
five words is one run. Rows with a null id get the component of their class. Rows of one id count as
one node. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import staged
from . import rings
from .forest import spanning
from .frames import arrow_map, text_key
from .textkit import Words, lower_ascii, mix, slices, text_buffers, xxh64

SHINGLE = 5
THRESHOLD = 0.8

#: Members and hashes of a block of an open group at most (about), and distinct hashes compared at once.
BLOCK_ROWS = 256
BLOCK_HASHES = 1 << 18
COLUMNS = 4096

#: Sets apart the second of the two sums by which equal sets are known.
_APART = np.uint64(0x9E6C63D0876A9A47)

#: Log of the bits of the filter that keeps texts without a partner from being dealt out; what it lets through in error is only work.
FILTER_BITS = 24


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))


def _sets(batches: Iterator[pa.RecordBatch], whole: bool, shingle: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        data, offsets = text_buffers(batch.column("text"))
        words = Words(lower_ascii(data), offsets)
        counts, first = words.counts, words.bounds[:-1]
        n = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
        row = np.repeat(np.arange(len(n)), n)
        at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        last = np.minimum(at + shingle, np.repeat(words.bounds[1:], n)) - 1
        hashes = xxh64(words.data, words.starts[at], words.ends[last], seed)
        order = np.lexsort((hashes, row))
        hashes = hashes[order]  # row is sorted already
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
        hashes, size = hashes[new], np.bincount(row[new], minlength=len(n))
        bounds = np.concatenate([[0], np.cumsum(size)])
        if whole:
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(hashes, bounds)], ["id", "hashes"])
            continue
        some = np.flatnonzero(size)
        heads = bounds[some]
        set_a, set_b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
        if len(some):
            with np.errstate(over="ignore"):
                set_a[some] = np.add.reduceat(mix(hashes), heads)
                set_b[some] = np.bitwise_xor.reduceat(mix(hashes + _APART), heads)
        prints = _lists(rings.fingerprints(hashes, size).ravel(), np.arange(len(n) + 1) * rings.WORDS)
        columns = [batch.column("id"), batch.column("key"), pa.array(size.astype(np.int64)), pa.array(set_a.view(np.int64)), pa.array(set_b.view(np.int64))]
        yield pa.RecordBatch.from_arrays([*columns, prints], ["id", "key", "n", "set_a", "set_b", "prints"])


def shingle_sets(df: DataFrame, whole: bool = False, shingle: int = SHINGLE, seed: int = 42) -> DataFrame:
    """Of (id, key, text): (id, key, n, set_a, set_b, prints), the size of a row's set, what tells it from others and its fingerprint; or whole, (id, hashes)."""
    return arrow_map(df, _sets, "id long, hashes array<long>" if whole else "id long, key long, n long, set_a long, set_b long, prints array<long>", whole, shingle, seed)


def _only(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``df`` whose id is a node, and some more: a bit filter of fixed size is sent to the rows, so that none is shuffled."""
    at = lambda c: F.xxhash64(c).bitwiseAND((1 << FILTER_BITS) - 1)
    bit = lambda c: F.expr(f"shiftleft(1L, cast(xxhash64({c}) & 63 as int))")
    table = nodes.groupBy(F.shiftright(at("node"), 6).alias("word")).agg(F.bit_or(bit("node")).alias("bits"))
    return df.join(F.broadcast(table), F.shiftright(at("id"), 6) == F.col("word")).filter(F.col("bits").bitwiseAND(bit("id")) != 0).select(df.columns)


def _similar(pairs: DataFrame, whole: DataFrame, threshold: float) -> DataFrame:
    """The (src, dst) of ``pairs`` whose whole sets overlap by ``threshold`` or more."""
    a = whole.select(F.col("id").alias("src"), F.col("hashes").alias("a"))
    b = whole.select(F.col("id").alias("dst"), F.col("hashes").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(a, "src").join(b, "dst").filter(both / (F.size("a") + F.size("b") - both) >= threshold).select("src", "dst")


def _pairs(members: DataFrame) -> DataFrame:
    """(src, dst): each member of groups (key, rep, first) with one first, that which it shares most groups with."""
    met = members.filter("rep <> first").groupBy("rep", "first").agg(F.count("*").alias("groups"))
    most = F.max_by("first", F.struct("groups", F.bitwise_not("first")))  # of several the smallest
    return met.groupBy("rep").agg(most.alias("src")).select("src", F.col("rep").alias("dst"))


def _blocks() -> Column:
    return F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_HASHES))


def _at(what: str, n: str) -> Column:
    return F.pmod(F.xxhash64(what), F.col(n))


def _owned(members: DataFrame, parts: DataFrame) -> DataFrame:
    """(rep, n, component, block): every member once; one of a large component with a block of its own there, others without."""
    own = members.select("rep", "n").distinct().groupBy("rep").agg(F.sum("n").alias("n"))
    own = own.join(parts, F.col("rep") == F.col("node"), "left").select("rep", "n", F.coalesce("component", "rep").alias("component"))
    large = own.groupBy("component").agg(F.count("*").alias("rows"), _blocks().alias("blocks")).filter(F.col("rows") * 2 >= BLOCK_ROWS).drop("rows")
    block = F.when(F.col("blocks").isNotNull(), F.xxhash64(F.lit("pure"), "component", _at("rep", "blocks")))
    return staged(own.join(large, "component", "left").select("rep", "n", "component", block.alias("block")), "own")


def _open(members: DataFrame, own: DataFrame) -> DataFrame:
    """(key, component, block, rep, n, low, size): what lies in groups of more than one component, a block of a large component as one row without a rep."""
    alone = F.when(F.col("block").isNull(), F.col("rep")).alias("rep")
    units = members.select("key", "rep").join(own, "rep").groupBy("key", "component", "block", alone).agg(F.max("n").alias("n"), F.count("*").alias("rows"))
    units = staged(units, "units")
    groups = units.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.sum("rows").alias("size"))
    return staged(units.drop("rows").join(groups.filter("low < high").drop("high"), "key"), "open")


def _placed(open_: DataFrame) -> DataFrame:
    """(rep, component, block): the members of open buckets outside large components, in blocks of at most about BLOCK_ROWS rows and BLOCK_HASHES hashes.

    Components that are joined by open buckets form a cluster. What a small cluster has of such
    members is a block; those of a large one lie with others of the largest bucket that they are in.
    """
    joined = open_.filter("component > low").select(F.col("component").alias("src"), F.col("low").alias("dst")).distinct()
    clusters = connected_components(joined).withColumnRenamed("component", "cluster")
    loose = open_.filter("block is null").groupBy("rep", "component", "n").agg(F.max_by("key", F.struct("size", "key")).alias("primary"))
    loose = staged(loose.join(clusters, F.col("component") == F.col("node")).drop("node"), "loose")
    for by in (["cluster"], ["cluster", "primary"]):
        name = "_".join(by)
        loose = loose.join(loose.groupBy(*by).agg(F.count("*").alias(f"{name}_rows"), _blocks().alias(f"{name}_blocks")), by)
    block = (
        F.when(F.col("cluster_blocks") == 1, F.xxhash64(F.lit("small"), "cluster"))
        .when(F.col("cluster_primary_rows") * 2 >= BLOCK_ROWS, F.xxhash64(F.lit("bucket"), "cluster", "primary", _at("rep", "cluster_primary_blocks")))
        .otherwise(F.xxhash64(F.lit("rest"), "cluster", _at("primary", "cluster_blocks")))
    )
    return staged(loose.select("rep", "component", block.alias("block")), "placed")


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, side, rep, component, hashes) sorted by tile and side: a spanning forest of each tile's links between components."""
    tile, held = None, []

    def settled():
        side, rep, component = (np.concatenate([np.asarray(x.column(c)) for x in held]) for c in ("side", "rep", "component"))
        lists = pa.concat_arrays([x.column("hashes") for x in held])
        size = np.asarray(lists.value_lengths()).astype(np.int64)
        row, values = np.repeat(np.arange(len(size)), size), np.asarray(lists.flatten())
        order = np.argsort(values, kind="stable")
        row, values = row[order], values[order]
        new = np.concatenate([[True], values[1:] != values[:-1]])
        column = np.cumsum(new) - 1
        shared = np.bincount(column)[column] > 1  # what one member alone has bears on its size only
        row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
        left = int((side == 0).sum())
        right = slice(left, None) if left < len(side) else slice(0, None)
        both = np.zeros((left, len(side) - right.start), np.float32)
        ends = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + COLUMNS + 1, COLUMNS))
        for k, (at, to) in enumerate(zip(ends, ends[1:], strict=False)):
            part = np.zeros((len(side), COLUMNS), np.float32)
            part[row[at:to], column[at:to] - k * COLUMNS] = 1
            both += part[:left] @ part[right].T
        both = both.astype(np.float64)
        near = both / (size[:left, None] + size[None, right] - both) >= threshold
        near &= component[:left, None] != component[None, right]
        i, j = np.nonzero(near)
        at, to = spanning(i, j + right.start, len(side))
        return pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(rep[to])], ["src", "dst"])

    for batch in batches:
        a, b = (np.asarray(batch.column(c)) for c in ("a", "b"))
        heads = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else []
        for at, to in zip(heads, [*heads[1:], len(a)], strict=True):
            if (a[at], b[at]) != tile:
                if held:
                    yield settled()
                tile, held = (a[at], b[at]), []
            held.append(batch.slice(at, to - at))
    if held:
        yield settled()


def _tiles(sides: DataFrame) -> DataFrame:
    """(a, b): the blocks that some bucket of the distinct (key, block, pure) brings together; buckets of the same blocks are one."""
    sums = F.count("*").alias("n"), F.bit_xor(F.xxhash64("block")).alias("x"), F.bit_xor(F.xxhash64("block", F.lit(1))).alias("y")
    one = sides.groupBy("key").agg(*sums).groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    few = staged(sides.join(one, "key", "left_semi"), "few")
    a = few.select("key", F.col("block").alias("a"), F.col("pure").alias("a_pure"))
    b = few.select("key", F.col("block").alias("b"), F.col("pure").alias("b_pure"))
    apart = F.col("a_pure").isNull() | F.col("b_pure").isNull() | (F.col("a_pure") != F.col("b_pure"))
    return staged(a.join(b, "key").filter((F.col("a") <= F.col("b")) & apart).select("a", "b").distinct(), "tiles")


def _across(open_: DataFrame, own: DataFrame, whole: DataFrame, threshold: float) -> DataFrame:
    """(src, dst) that join the components that meet in open buckets, as a forest for each pair of blocks.

    Blocks that some bucket brings together meet in one task, which holds the sets of both and no more.
    """
    placed = _placed(open_)
    pure = open_.filter("block is not null").select("key", "block", F.col("component").alias("pure"))
    loose = open_.filter("block is null").select("key", "rep").join(placed, "rep").select("key", "block", F.lit(None).cast("long").alias("pure"))
    tiles = _tiles(staged(pure.union(loose).distinct(), "sides"))
    member = placed.select("block", "rep", "component").union(own.filter("block is not null").select("block", "rep", "component"))
    sent = tiles.join(member, F.col("a") == F.col("block")).withColumn("side", F.lit(0))
    sent = sent.union(tiles.filter("a < b").join(member, F.col("b") == F.col("block")).withColumn("side", F.lit(1)))
    sent = sent.join(whole, F.col("rep") == F.col("id")).select("a", "b", "side", "rep", "component", "hashes")
    return arrow_map(sent.repartition("a", "b").sortWithinPartitions("a", "b", "side"), _compare, "src long, dst long", threshold)


def links(df: DataFrame, classes: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(src, dst) between the smallest ids ``rep`` of classes (rep, n, prints) of df(id, text); their components are those of all proposed links."""
    members = staged(rings.groups(classes, threshold), "members")
    nodes = staged(members.select(F.col("rep").alias("node")).distinct(), "nodes")
    whole = shingle_sets(_only(df, nodes), True, shingle).join(nodes, F.col("id") == F.col("node"), "left_semi")
    whole = staged(whole.distinct(), "whole")
    found = staged(_similar(_pairs(members), whole, threshold), "links")
    own = _owned(members, staged(connected_components(found), "parts"))
    return found.union(staged(_across(_open(members, own), own, whole, threshold), "across"))


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(id, key, component_id) of every row of ``df``; key tells texts of one id apart."""
    text = F.col(f"`{text_col}`").cast("string")
    source = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_key(text).alias("key"), text.alias("text"))
    sets = staged(shingle_sets(source, False, shingle), "sets")
    own = F.struct("n", "prints")
    classes = staged(sets.groupBy("set_a", "set_b").agg(F.min("id").alias("rep"), F.first(own).alias("x")).select("set_a", "set_b", "rep", "x.n", "x.prints"), "classes")
    parts = connected_components(links(source, classes, shingle, threshold))
    named = classes.join(parts, F.col("rep") == F.col("node"), "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component_id"))
    return sets.select("id", "key", "set_a", "set_b").join(named, ["set_a", "set_b"]).select("id", "key", "component_id")
