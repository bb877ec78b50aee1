"""Vectors as array columns: norms, cosines, nearest rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def nearest(queries: DataFrame, rows: DataFrame, id_col: str, vector_col: str, k: int, group: int = 1_000, part: int = 20_000) -> DataFrame:
    """(query, id, cosine): the k rows nearest to each query, however many there are.

    Queries are dealt into groups of about ``group`` by a hash of their ids, rows into parts of about
    ``part`` at most; each group meets each part once and keeps k rows a query, and the best of
    those are taken.
    """
    groups = max(1, -(-queries.count() // group))
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // part))
    dealt = lambda n: F.pmod(F.xxhash64(id_col), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    values = [F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")]
    sent = queries.select(dealt(groups).alias("g"), every(parts).alias("p"), *values)
    met = rows.select(every(groups).alias("g"), dealt(parts).alias("p"), *values)

    def best(left, right):
        ids, own = left["id"].to_numpy(), right["id"].to_numpy()
        if not len(ids) or not len(own):
            return left.iloc[:0][["id"]].assign(query=0, cosine=0.0)[["query", "id", "cosine"]]
        a, b = (np.array(t["v"].tolist(), np.float64) for t in (left, right))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        out = []
        for at in range(0, len(ids), 256):  # bounds the matrix of cosines
            c = np.round(a[at : at + 256] @ b.T, 6)
            c[ids[at : at + 256, None] == own[None, :]] = -np.inf
            order = np.lexsort((np.broadcast_to(own, c.shape), -c), axis=1)[:, :k]
            out.append(type(left)({"query": np.repeat(ids[at : at + 256], order.shape[1]), "id": own[order].ravel(), "cosine": np.take_along_axis(c, order, 1).ravel()}))
        return type(left)({n: np.concatenate([o[n] for o in out]) for n in ("query", "id", "cosine")})

    found = sent.groupBy("g", "p").cogroup(met.groupBy("g", "p")).applyInPandas(best, "query long, id long, cosine double").filter(F.col("cosine") > float("-inf"))
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "id")
    return found.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).select("query", F.col("id").alias(id_col), "cosine")


def _moments(batches, width: int):
    import pyarrow as pa

    n, total, square = 0, np.zeros(width), np.zeros((width, width))
    for batch in batches:
        v = batch.column("v")
        whole = np.asarray(v.value_lengths().fill_null(-1)) == width
        x = np.asarray(v.filter(pa.array(whole)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)
        x = x[np.isfinite(x).all(axis=1)]
        n, total, square = n + len(x), total + x.sum(axis=0), square + x.T @ x
    yield pa.RecordBatch.from_arrays(
        [pa.array([n]), pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([square.ravel().tolist()], pa.list_(pa.float64()))], ["n", "total", "square"]
    )


def principal(rows: DataFrame, id_col: str, vector_col: str, k: int = 2) -> tuple[DataFrame, list[float]]:
    """(id, the k leading principal coordinates) of every row, and the k shares of the variance.

    The covariance is summed in one pass, a matrix of the vectors' width from each task. Directions are
    signed so that their largest component is positive. Vectors that are null, of another width than
    the first that counts (the longest) or not finite have no coordinates.
    """
    d = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    width = d.agg(F.max(F.size("v"))).first()[0] or 0
    if width < 1:
        return d.select("id", F.lit(None).cast("array<double>").alias("coordinates")), []
    sums = d.select("v").mapInArrow(lambda b: _moments(b, width), "n long, total array<double>, square array<double>").filter("n > 0")
    n, total, square = 0, np.zeros(width), np.zeros((width, width))
    for part in sums.toLocalIterator():  # a row a task, one at a time
        n, total, square = n + part["n"], total + np.array(part["total"]), square + np.array(part["square"]).reshape(width, width)
    if not n:
        return d.select("id", F.lit(None).cast("array<double>").alias("coordinates")), []
    mean = total / n
    values, directions = np.linalg.eigh((square - n * np.outer(mean, mean)) / max(n - 1, 1))
    order = np.argsort(-values, kind="stable")[:k]
    values, directions = np.maximum(values, 0), directions[:, order]
    directions = directions * np.where(directions[np.abs(directions).argmax(axis=0), np.arange(directions.shape[1])] < 0, -1, 1)
    centred = F.zip_with("v", F.lit(mean.tolist()), lambda x, m: x - m)
    good = (F.size("v") == width) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    each = [dot(centred, F.lit(directions[:, j].tolist())) for j in range(directions.shape[1])]
    shares = (values[order] / values.sum()).tolist() if values.sum() else [0.0] * len(order)
    return d.select("id", F.when(good, F.array(*each)).alias("coordinates")), shares


def linkage_order(matrix: np.ndarray) -> list[int]:
    """The leaves of an average-linkage tree of a similarity matrix (a panel of bounded size, on the driver), so that like stand together."""
    near = np.array(matrix, float)
    groups = {k: [k] for k in range(len(near))}
    while len(groups) > 1:
        keys = sorted(groups)
        mean = lambda a, b: near[np.ix_(groups[a], groups[b])].mean()
        _, a, b = max(((mean(a, b), -a, -b) for i, a in enumerate(keys) for b in keys[i + 1 :]))
        groups[-a] = groups[-a] + groups.pop(-b)
    return next(iter(groups.values()), [])
