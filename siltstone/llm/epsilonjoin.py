"""Embedding near-duplicates by an epsilon grid order join.

Vectors of unit length have a cosine of at least c exactly where they are at most
eps = sqrt(2 - 2c) apart. They are turned onto their principal directions (of a bounded sample;
any rotation keeps distances, so the sample bears on speed alone), sorted by the grid cells of
width eps in the leading ones, and cut into intervals of that order. Boxes around intervals tell
which lie further apart than eps: pairs of intervals are refined from the whole order down, level
by level, and those that can't hold a link go. What is left is dealt out in tiles; in a task the
join goes on recursively by halves of its intervals, skips distant halves, and compares the rest
by single-precision products. Pairs near or above c are decided in doubles.

Copies are one vector from the start, with the smallest id and their number, so a vector that very
many rows hold is compared once. For each vector a task puts out how many it links with, and for
each pair of blocks a spanning forest of the links, not the links.

Vectors that are null, zero, or hold null or non-finite components link with nothing; shorter
vectors end in zeros. Rows that share an id but not their vector have the links of
their own vector each. Rows with a null id link like others; their component is the smallest id that
they reach, if any. An empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.graph import connected_components
from ..session import staged
from .forest import spanning
from .frames import arrow_map
from .vectors import matrix, widened

#: Vectors and bytes of an interval, vectors of a block compared at once, and intervals along a tile's edge at most.
INTERVAL = 4096
INTERVAL_BYTES = 2 << 20
BLOCK = 512
EDGE = 16
FANOUT = 16
#: Principal directions that the grid and the boxes have, and the rows they are taken from at most.
DIRECTIONS = 8
SAMPLE = 20_000
_SLACK = 1e-4


def _usable(vector: str):
    """Whether a column holds a vector that can link."""
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return F.coalesce(v.isNotNull() & good & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares stay in range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def directions(classes: DataFrame) -> np.ndarray:
    """The principal directions of a sample, (width, DIRECTIONS); the smallest hashes, so reruns agree."""
    rows = classes.select("vector").orderBy(F.xxhash64("vector")).limit(SAMPLE).toArrow()
    x, _ = matrix(rows.column("vector"))
    if not len(x):
        return np.zeros((1, 1))
    values, vectors = np.linalg.eigh(np.cov(_unit(x).T).reshape(x.shape[1], x.shape[1]) if len(x) > 1 else np.eye(x.shape[1]))
    return np.ascontiguousarray(vectors[:, np.argsort(-values, kind="stable")[:DIRECTIONS]])


def _cells(batches: Iterator[pa.RecordBatch], turn: np.ndarray, eps: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, _ = matrix(batch.column("vector"))
        y = _leading(_unit(x), turn) if len(x) else np.zeros((0, turn.shape[1]))
        cells = pa.FixedSizeListArray.from_arrays(pa.array(np.floor(y / eps).astype(np.int32).ravel()), turn.shape[1]).cast(pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*batch.columns, cells], [*batch.schema.names, "cells"])


def _leading(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    width = max(x.shape[1], len(turn))
    return widened(x, width) @ np.concatenate([turn, np.zeros((width - len(turn), turn.shape[1]))])


def _pack(batches: Iterator[pa.RecordBatch], turn: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Intervals of sorted rows, with their boxes."""
    from pyspark import TaskContext

    part, seq, held = TaskContext.get().partitionId(), 0, []

    def packed(rows):
        x, _ = matrix(rows.column("vector"))
        y = _leading(_unit(x), turn)
        lists = [pa.array([v.tolist()], pa.list_(pa.float64())) for v in (y.min(axis=0), y.max(axis=0))]
        blobs = [pa.array([np.asarray(v).astype(t).tobytes()], pa.binary()) for v, t in ((rows.column("rep"), "<i8"), (rows.column("n"), "<i8"), (x, "<f8"))]
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int64()), pa.array([seq], pa.int64()), *lists, *blobs], ["part", "seq", "lo", "hi", "reps", "ns", "vectors"]
        )

    size = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            take = min(most - size, batch.num_rows - at)
            held.append(batch.slice(at, take))
            size, at = size + take, at + take
            if size == most:
                yield packed(pa.Table.from_batches(held).combine_chunks())
                held, size, seq = [], 0, seq + 1
    if size:
        yield packed(pa.Table.from_batches(held).combine_chunks())


def _apart(a: str, b: str):
    """The square of the distance between two boxes."""
    gap = lambda x, y: F.greatest(y - x, F.lit(0.0))
    one = F.zip_with(F.col(f"{a}_hi"), F.col(f"{b}_lo"), gap)
    other = F.zip_with(F.col(f"{b}_hi"), F.col(f"{a}_lo"), gap)
    both = F.zip_with(one, other, lambda x, y: x * x + y * y)
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def _tiles(boxes: DataFrame, count: int, edge: int, eps: float) -> DataFrame:
    """(a, b), a <= b: pairs of tiles of ``edge`` intervals that may hold a link, refined from the whole order down."""

    def level(width: int) -> DataFrame:
        each = F.floor(F.col("number") / width)
        lo = [F.min(F.col("lo")[k]) for k in range(DIRECTIONS)]
        hi = [F.max(F.col("hi")[k]) for k in range(DIRECTIONS)]
        return boxes.groupBy(each.alias("node")).agg(F.array(*lo).alias("lo"), F.array(*hi).alias("hi"))

    pairs, width = None, edge
    widths = [edge]
    while widths[-1] < count:
        widths.append(widths[-1] * FANOUT)
    for width in reversed(widths):
        nodes = level(width)
        parent = F.floor(F.col("node") / FANOUT)
        a = nodes.select(F.col("node").alias("a"), parent.alias("a_up"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
        b = nodes.select(F.col("node").alias("b"), parent.alias("b_up"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
        if pairs is None:
            pairs = a.join(b, F.col("a") == F.col("b"))
        else:
            pairs = pairs.join(a, "a_up").join(b, "b_up")
        kept = pairs.filter((F.col("a") <= F.col("b")) & (_apart("a", "b") <= eps * eps + _SLACK))
        pairs = kept.select(F.col("a").alias("a_up"), F.col("b").alias("b_up"))
    return pairs.select(F.col("a_up").alias("a"), F.col("b_up").alias("b"))


class _Interval:
    def __init__(self, number: int, reps: bytes, ns: bytes, vectors: bytes, turn: np.ndarray) -> None:
        self.number = number
        self.rep, self.n = np.frombuffer(reps, "<i8"), np.frombuffer(ns, "<i8")
        x = np.frombuffer(vectors, "<f8").reshape(len(self.rep), -1)
        unit = _unit(x)
        self.single = unit.astype(np.float32)
        self.lead = _leading(unit, turn)
        # a power of two more or less changes no digit of a cosine, and keeps squares in range
        self.scaled = x * np.exp2(-np.floor(np.log2(np.abs(x).max(axis=1, keepdims=True))))
        self.norm = np.sqrt((self.scaled * self.scaled).sum(axis=1))
        self.boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if (a, b) not in self.boxes:
            self.boxes[a, b] = self.lead[a:b].min(axis=0), self.lead[a:b].max(axis=0)
        return self.boxes[a, b]


def _compare(p: _Interval, q: _Interval, least: float, eps: float, counts, links) -> None:
    """Join two intervals, or one with itself, recursively."""
    same, limit = p.number == q.number, eps * eps + _SLACK
    todo = [(0, len(p.rep), 0, len(q.rep))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d or (same and d <= a):  # of an interval with itself, only what lies above the diagonal
            continue
        lo, hi = p.box(a, b)
        lo2, hi2 = q.box(c, d)
        gap = np.maximum(0, np.maximum(lo2 - hi, lo - hi2))
        if (gap * gap).sum() > limit:
            continue
        if b - a > BLOCK or d - c > BLOCK:
            if b - a >= d - c:
                m = (a + b) // 2
                todo += [(a, m, c, d), (m, b, c, d)]
            else:
                m = (c + d) // 2
                todo += [(a, b, c, m), (a, b, m, d)]
            continue
        i, j = np.nonzero(p.single[a:b] @ q.single[c:d].T >= least - _SLACK)
        i, j = i + a, j + c
        if same:  # each pair once
            below = i < j
            i, j = i[below], j[below]
        if not len(i):
            continue
        dot = np.einsum("ij,ij->i", p.scaled[i], q.scaled[j]) / (p.norm[i] * q.norm[j])
        ok = dot >= least
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        np.add.at(counts[p.number], i, q.n[j])
        np.add.at(counts[q.number], j, p.n[i])
        at, to = spanning(i - a, j - c + b - a, b - a + d - c) if not same else spanning(i, j, len(p.rep))
        rep = np.concatenate([p.rep[a:b], q.rep[c:d]]) if not same else p.rep
        links.append((rep[at], rep[to]))


def _join(batches: Iterator[pa.RecordBatch], turn: np.ndarray, least: float, eps: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile and side: a tile's first intervals are held, the others pass by. Gives (src, dst, n):
    a link if dst is set, otherwise n more links for src."""
    tile, held, counts, keep = None, [], {}, {}

    def out(src, dst, n):
        return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(n, pa.int64())], ["src", "dst", "n"])

    def close(which):
        for number in which:
            c, rep = counts.pop(number), keep.pop(number)
            on = np.flatnonzero(c)
            if len(on):
                yield out(rep[on], [None] * len(on), c[on])

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("a", "b", "side", "number", "reps", "ns", "vectors"))
        for a, b, side, number, reps, ns, vectors in zip(*columns, strict=True):
            if (a, b) != tile:
                yield from close(list(counts))
                tile, held = (a, b), []
            new = _Interval(number, reps, ns, vectors, turn)
            counts.setdefault(number, np.zeros(len(new.rep), np.int64))
            keep[number] = new.rep
            links: list = []
            if side == 0:
                held.append(new)
            if a == b:  # a tile with itself: each interval with those before it and itself
                against = held
            else:
                against = [] if side == 0 else held
            for other in against:
                _compare(other, new, least, eps, counts, links)
            for src, dst in links:
                yield out(src, dst, np.zeros(len(src), np.int64))
            if side == 1:
                yield from close([number])
    yield from close(list(counts))


def near_duplicates(df: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row: links are pairs of rows with a cosine of ``least`` or more."""
    eps = math.sqrt(max(0.0, 2 - 2 * least))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    rows = rows.withColumn("usable", _usable("vector")).withColumn("k1", F.xxhash64("vector")).withColumn("k2", F.xxhash64(F.lit(1), "vector"))
    classes = staged(
        rows.filter("usable").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.min("vector").alias("vector")), "classes"
    )
    # a class is known by a hash of its vector, which rows without an id have too
    counted, labels = _linked(classes.select(F.col("k1").alias("rep"), "n", "vector"), least, eps)
    placed = classes.select("k1", "k2", F.col("rep").alias("id"), "n").join(labels, F.col("k1") == F.col("node"), "left")
    placed = staged(placed.withColumn("component", F.coalesce("component", "k1")).drop("node"), "placed")
    lowest = placed.groupBy("component").agg(F.min("id").alias("lowest"))
    named = placed.join(lowest, "component").join(counted, F.col("k1") == F.col("rep"), "left")
    named = named.select(
        F.col("k1").alias("c1"), F.col("k2").alias("c2"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.col("lowest").alias("component")
    )
    out = rows.select("id", "usable", "k1", "k2").join(named, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & F.col("usable"), "left")
    component = F.coalesce(F.when(F.col("usable"), F.col("component")), F.col("id"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce(F.when(F.col("usable"), F.col("n_links")), F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )


def _linked(classes: DataFrame, least: float, eps: float) -> tuple[DataFrame, DataFrame]:
    """(rep, links) and (node, component) of the classes (rep, n, vector)."""
    spark = classes.sparkSession
    turn = directions(classes)
    width = turn.shape[1]
    if width < DIRECTIONS:
        turn = np.concatenate([turn, np.zeros((len(turn), DIRECTIONS - width))], axis=1)
    schema = classes.select("rep", "n", "vector").schema
    celled = arrow_map(classes.select("rep", "n", "vector"), _cells, T.StructType([*schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))]), turn, eps)
    # what a tile holds is bounded in bytes, however wide vectors are
    most = max(1, min(INTERVAL, INTERVAL_BYTES // (8 * (classes.agg(F.max(F.size("vector"))).first()[0] or 1))))
    ordered = celled.repartitionByRange("cells", "rep").sortWithinPartitions("cells", "rep").drop("cells")
    packed = staged(
        arrow_map(ordered, _pack, "part long, seq long, lo array<double>, hi array<double>, reps binary, ns binary, vectors binary", turn, most), "intervals"
    )
    # a partition's intervals follow those of the partitions before it; one row a partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = packed.groupBy("part").agg(F.count("*").alias("k")).withColumn("ahead", F.coalesce(F.sum("k").over(before), F.lit(0))).drop("k")
    numbered = packed.join(parts, "part").withColumn("number", F.col("ahead") + F.col("seq")).drop("part", "seq", "ahead")
    count = packed.count()
    edge = max(1, min(EDGE, math.ceil(count / math.ceil(math.sqrt(2 * spark.sparkContext.defaultParallelism)))))
    pairs = staged(_tiles(numbered.select("number", "lo", "hi"), max(count, 1), edge, eps), "tiles")
    load = numbered.select("number", F.floor(F.col("number") / edge).alias("tile"), "reps", "ns", "vectors")
    names = ["a", "b", "side", "number", "reps", "ns", "vectors"]
    first = pairs.join(load, F.col("a") == F.col("tile")).withColumn("side", F.lit(0)).select(*names)
    second = pairs.filter("a < b").join(load, F.col("b") == F.col("tile")).withColumn("side", F.lit(1)).select(*names)
    dealt = first.unionByName(second)
    n_tiles = max(1, min(pairs.count(), 20_000))
    dealt = dealt.repartition(n_tiles, "a", "b").sortWithinPartitions("a", "b", "side")
    found = staged(arrow_map(dealt, _join, "src long, dst long, n long", turn, least, eps), "found")
    counted = found.filter("dst is null").groupBy(F.col("src").alias("rep")).agg(F.sum("n").alias("links"))
    labels = connected_components(found.filter("dst is not null").select("src", "dst"))
    return counted, labels


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e,
         embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings
), links AS (
  SELECT a.vec_id AS src, b.vec_id AS dst FROM v a, v b
  WHERE a.ok AND b.ok AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS node, vec_id AS root FROM v
  UNION
  SELECT l.dst, r.root FROM reach r JOIN links l ON l.src = r.node
), comp AS (
  SELECT node, min(root) AS component_id FROM reach GROUP BY node
)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE src = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN comp c ON c.node = v.vec_id
"""
