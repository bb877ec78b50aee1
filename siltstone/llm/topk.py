"""Exact top-k inner products by multi-resolution segment statistics.

Vectors are cut into segments of neighbouring components. Of each segment the mean and the
deviation (the length of what remains when the mean is taken off) bound its part of an inner
product from above, and so the distance |q|^2 + |x|^2 - 2 qx from below:
q.x <= sum over segments of len * mean_q * mean_x + dev_q * dev_x. Bounds are taken coarse to fine,
against the k-th best score that a query has so far; what survives is scored exactly. Where the
coarse level leaves most pairs of a block, the finer level would too, and the block is scored whole.

Rows are ordered by cells of their coarse segment means and packed into blocks, queries likewise into
groups. Blocks and groups have the least and greatest of each statistic, which bound all inner
products between them. Each group first meets the two blocks that promise most; what its queries
have then is a floor. Of all other blocks only those whose bound reaches the group's floor are sent
to it, in shares: a task holds one group of queries with their k best while it streams the blocks of
its share past them. It puts out at most k rows a query, none below the floor.

Components are floor(scale * x) as exact integers, scores exact sums. Vectors that are null or hold
null or non-finite components take no part. Shorter vectors end in zeros. Rows that share a query's
id are its own and no candidates; equal rows of one query count once. Ties go to the smaller id, and
between rows of one id and score all stand. Rows with a null id take no part. Scores that leave the
64-bit range raise an error. Fewer candidates than k give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import staged
from .frames import arrow_map
from .vectors import matrix, widened

#: Vectors of a block and of a group of queries, and bytes that they have at most.
BLOCK = 4096
BLOCK_BYTES = 4 << 20
#: Segments of each resolution.
LEVELS = (4, 16)
#: Candidates that one task streams past a group of queries.
SHARE = 1 << 20
#: Integers up to here have exact inner products of up to 128 components in doubles.
_EXACT = 1 << 22


def _coarse(batches: Iterator[pa.RecordBatch], scale: float, width: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, vector) that take part, with the means of their coarse segments."""
    for batch in batches:
        x, good = matrix(batch.column("vector"))
        kept = batch.filter(pa.array(good))
        means = features(widened(np.floor(x[good] * scale), width), LEVELS[0])[:, : min(LEVELS[0], width)]
        lists = pa.FixedSizeListArray.from_arrays(pa.array(means.ravel()), means.shape[1]).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*kept.columns, lists], ["id", "vector", "means"])


def _pack(batches: Iterator[pa.RecordBatch], scale: float, width: int, most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted rows (id, vector): ids, integers, and the least and greatest of each statistic."""
    part, seq, size, held = TaskContext.get().partitionId(), 0, 0, []

    def packed():
        rows = pa.Table.from_batches(held)
        x = widened(np.floor(matrix(rows.column("vector"))[0] * scale), width)
        ids = np.asarray(rows.column("id"))
        own = np.concatenate([features(x, n) for n in LEVELS], axis=1)
        lists = [pa.array([v.tolist()], pa.list_(pa.float64())) for v in (own.min(axis=0), own.max(axis=0))]
        blobs = [pa.array([v], pa.binary()) for v in (ids.astype("<i8").tobytes(), x.astype("<f8").tobytes())]
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) + seq]), pa.array([len(ids)], pa.int64()), *lists, *blobs], ["block", "n", "lo", "hi", "ids", "vectors"])

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            take = min(most - size, batch.num_rows - at)
            held.append(batch.slice(at, take).select(["id", "vector"]))
            size, at = size + take, at + take
            if size == most:
                yield packed()
                held, size, seq = [], 0, seq + 1
    if size:
        yield packed()


def features(x: np.ndarray, segments: int) -> np.ndarray:
    """Per segment the mean times the root of its length, then the deviation: their inner products bound those of x."""
    cuts = np.unique(np.arange(segments) * x.shape[1] // segments)
    n = np.diff(np.append(cuts, x.shape[1]))
    total = np.add.reduceat(x, cuts, axis=1)
    square = np.add.reduceat(x * x, cuts, axis=1)
    return np.concatenate([total / np.sqrt(n), np.sqrt(np.maximum(square - total * total / n, 0))], axis=1)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) <= _EXACT and q.shape[1] <= 128:
        return (q @ x.T).astype(np.int64)
    whole = np.array([[int(v) for v in r] for r in q], object) @ np.array([[int(v) for v in r] for r in x], object).T
    if len(q) and len(x) and max(abs(whole.max()), abs(whole.min())) >= 1 << 63:
        raise OverflowError("an inner product leaves the 64-bit range")
    return whole.astype(np.int64)


class Best:
    """The k best of a group of queries so far, of those that reach the floor."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, floor: int | None = None) -> None:
        self.ids, self.q, self.k = ids, q, k
        self.score = np.full((len(ids), k), np.iinfo(np.int64).min if floor is None else floor - 1)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self._features = [features(q, s) for s in LEVELS]

    def offer(self, ids: np.ndarray, x: np.ndarray) -> None:
        width = max(self.q.shape[1], x.shape[1])
        if width > self.q.shape[1]:
            self.q = widened(self.q, width)
            self._features = [features(self.q, s) for s in LEVELS]
        x = widened(x, width)
        own = [features(x, s) for s in LEVELS]
        for a in range(0, len(self.ids), 512):
            at = slice(a, a + 512)
            least = self.score[at, -1]
            near = None
            if (least > np.iinfo(np.int64).min).all():
                slack = 1 + 1e-9 * np.abs(least)  # far above what rounding does to the bounds
                for level, mine in zip(self._features, own, strict=True):
                    bound = level[at] @ mine.T >= (least - slack)[:, None]
                    near = bound if near is None else near & bound
                    left = np.flatnonzero(near.any(axis=0))
                    if near.mean() > 0.5 or not len(left):
                        break
                if not len(left):
                    continue
                ids_, x_ = ids[left], x[left]
            else:
                ids_, x_ = ids, x
            self._take(at, ids_, _exact(self.q[at], x_))

    def _take(self, at: slice, ids: np.ndarray, scores: np.ndarray) -> None:
        lowest = np.iinfo(np.int64).min
        worst, last = self.score[at, -1:], self.found[at, -1:]
        better = (scores > worst) | ((scores == worst) & (ids[None, :] < last))
        better &= ids[None, :] != self.ids[at, None]
        hits = better.sum(axis=1)
        many = np.flatnonzero(hits > 64)
        if len(many):  # only what reaches the k-th best of them
            cut = np.where(better[many], scores[many], lowest)
            kth = np.partition(cut, cut.shape[1] - self.k, axis=1)[:, [-self.k]] if cut.shape[1] >= self.k else np.full((len(many), 1), lowest)
            better[many] &= scores[many] >= kth
        row, col = np.nonzero(better)
        if not len(row):
            return
        touched = np.unique(row)
        rows = np.concatenate([row, np.repeat(touched, self.k)])
        s = np.concatenate([scores[row, col], self.score[at][touched].ravel()])
        i = np.concatenate([ids[col], self.found[at][touched].ravel()])
        order = np.lexsort((i, np.invert(s), rows))
        rows, s, i = rows[order], s[order], i[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        top = rank < self.k
        self.score[at.start + rows[top], rank[top]] = s[top]
        self.found[at.start + rows[top], rank[top]] = i[top]

    def rows(self) -> pa.RecordBatch | None:
        full = self.found < np.iinfo(np.int64).max
        if not full.any():
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.ids, full.sum(axis=1))), pa.array(self.found[full]), pa.array(self.score[full])], ["query_id", "vec_id", "score"]
        )


def _unpacked(n: int, ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<f8").reshape(n, -1)


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group, share and side: a group's queries, then its blocks."""
    key, best = None, None
    for batch in batches:
        for g, share, side, floor, n, ids, vectors in zip(*(batch.column(c).to_pylist() for c in ("g", "share", "side", "floor", "n", "ids", "vectors")), strict=True):
            if (g, share) != key:
                if best is not None and (out := best.rows()) is not None:
                    yield out
                key, best = (g, share), None
            own, x = _unpacked(n, ids, vectors)
            if side == 0:  # equal rows of a query are one query
                rows = np.unique(np.concatenate([own.view("<f8")[:, None], x], axis=1).view("V%d" % (8 + 8 * x.shape[1])), return_index=True)[1]
                best = Best(own[rows], x[rows], k, floor)
            elif best is not None:
                best.offer(own, x)
    if best is not None and (out := best.rows()) is not None:
        yield out


def _packed(rows: DataFrame, scale: float, width: int, name: str) -> DataFrame:
    """Staged blocks of the rows (id, vector), neighbours by their coarse means together."""
    coarse = staged(arrow_map(rows, _coarse, "id long, vector array<double>, means array<double>", scale, width), f"{name}-means")
    m = min(LEVELS[0], width)
    spread = coarse.agg(*[F.avg(F.col("means")[i]) for i in range(m)], *[F.stddev_pop(F.col("means")[i]) for i in range(m)]).first()
    cells = [F.floor((F.col("means")[i] - F.lit(float(spread[i] or 0))) / F.lit(float(spread[m + i] or 0) or 1.0)) for i in range(m)]
    ordered = coarse.select("id", "vector", F.array(*cells).alias("cells")).repartitionByRange("cells", "id").sortWithinPartitions("cells", "id")
    kind = "block long, n long, lo array<double>, hi array<double>, ids binary, vectors binary"
    return staged(arrow_map(ordered.drop("cells"), _pack, kind, scale, width, max(1, min(BLOCK, BLOCK_BYTES // (8 * width)))), name)


def _bounds(width: int) -> tuple:
    """From q_lo, q_hi, lo, hi: the most that an inner product can be by each level, and what that of the middles is."""
    out, at = [], 0
    for level in LEVELS:
        n = 2 * min(level, width)
        each = [
            F.greatest(*[F.col(a)[i] * F.col(b)[i] for a in ("q_lo", "q_hi") for b in ("lo", "hi")]) for i in range(at, at + n)
        ]
        out.append(functools.reduce(lambda a, b: a + b, each))
        at += n
    n = min(LEVELS[-1], width)
    first = 2 * min(LEVELS[0], width)
    middle = functools.reduce(lambda a, b: a + b, [(F.col("q_lo")[i] + F.col("q_hi")[i]) * (F.col("lo")[i] + F.col("hi")[i]) for i in range(first, first + n)])
    return F.least(*out), middle / 4


def _scored(asked: DataFrame, blocks: DataFrame, pairs: DataFrame, k: int, tasks: int) -> DataFrame:
    """(query_id, vec_id, score) that come of ``pairs`` (g, block, floor, share)."""
    sent = asked.select(F.col("block").alias("g"), "n", "ids", "vectors")
    left = pairs.select("g", "share", "floor").distinct().join(sent, "g").withColumn("side", F.lit(0))
    right = pairs.join(blocks.select("block", "n", "ids", "vectors"), "block").withColumn("side", F.lit(1))
    names = ["g", "share", "side", "floor", "n", "ids", "vectors"]
    both = left.select(*names).unionByName(right.select(*names))
    return arrow_map(both.repartition(tasks, "g", "share").sortWithinPartitions("g", "share", "side"), _search, "query_id long, vec_id long, score long", k)


def search(
    candidates: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of highest inner product with each query."""
    found = None
    spark = candidates.sparkSession
    narrow = [F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector")]
    rows, asked = (x.select(*narrow).filter("id is not null") for x in (candidates, queries))
    width = max(1, *[x.agg(F.max(F.size("vector"))).first()[0] or 1 for x in (rows, asked)])
    blocks, groups = _packed(rows, scale, width, "blocks"), _packed(asked, scale, width, "groups")
    cores = spark.sparkContext.defaultParallelism
    bound, middle = _bounds(width)
    # narrow rows: a group of queries against a block each
    stats = groups.select(F.col("block").alias("g"), F.col("n").alias("q_n"), F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi"))
    pairs = staged(stats.crossJoin(blocks.select("block", "lo", "hi")).select("g", "block", "q_n", bound.alias("bound"), middle.alias("middle")), "pairs")
    first = pairs.groupBy("g").agg(F.max_by("block", F.struct("bound", "block")).alias("a"), F.max_by("block", F.struct("middle", "block")).alias("b"))
    first = first.select("g", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    nothing = F.lit(None).cast("long")
    ahead = staged(_scored(groups, blocks, first.withColumns({"floor": nothing, "share": F.lit(0).cast("long")}), k, cores), "first")
    # a group's floor: the least k-th best of its queries, if all have k
    of_group = groups.select(F.col("block").alias("g"), "n", F.col("ids"))
    kth = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))).filter(F.col("rank") == k)
    members = arrow_map(of_group, _members, "g long, query_id long")
    floors = members.join(kth.select("query_id", "score"), "query_id", "left").groupBy("g").agg(F.when(F.count("*") == F.count("score"), F.min("score")).alias("floor"))
    reach = F.col("bound") + 1 + 1e-9 * F.abs("bound") >= F.col("floor")
    left = pairs.join(floors, "g").filter(F.col("floor").isNull() | reach).join(first, ["g", "block"], "left_anti").select("g", "block", "floor")
    left = staged(left, "left")
    n_left, n_groups = left.count(), max(1, groups.count())
    if n_left:
        tasks = max(cores, -(-n_left * BLOCK // SHARE))
        # each group's blocks in about as many shares as it takes to have work for all tasks
        shares = left.groupBy("g").agg(F.greatest(F.lit(1), F.ceil(F.count("*") * tasks / n_left)).alias("shares"))
        dealt = left.join(shares, "g").withColumn("share", F.pmod(F.xxhash64("block"), F.col("shares")))
        found = _scored(groups, blocks, dealt.select("g", "block", "floor", "share"), k, max(tasks, min(n_groups, 20_000)))
    found = ahead if found is None else ahead.unionByName(found)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for g, ids in zip(batch.column("g").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            own = np.unique(np.frombuffer(ids, "<i8"))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), g)), pa.array(own)], ["g", "query_id"])


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
