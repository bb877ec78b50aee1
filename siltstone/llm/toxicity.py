"""Toxicity as a severity grade, by cumulative-link ordinal regression on sparse text features.

P(grade >= k | x) = sigmoid(w.x - t_k) for k = 1 .. GRADES: one weight for each feature, shared by
all thresholds t_1 < t_2 < ... The expected severity is the sum of these probabilities. Features
are lower-cased words (runs of letters and digits), hashed into ``BUCKETS``; x is 1 + log(count).
Only buckets that go with toxic labels beyond chance enter: by the likelihood ratio of their
document frequencies, which are counted on the executors, at most ``FEATURES`` of them.

Labels say toxic or not, so the steps between grades of toxic documents come from cross-fitting: the
sample is cut in ``FOLDS`` by a hash of the id, each fold's documents are scored by a regression with
one threshold that is fitted on the other folds, and the toxic documents of a fold are graded 1 to
GRADES by the quantiles of these held-out scores among them. Clean documents have grade 0. The fit is
on the bounded labelled sample and takes place on the driver, over the counts of each document's features.

Nulls and texts without words have no features; a document without any has the probabilities of
its thresholds alone. Without labels of both kinds, or without features, severity is 0 throughout.
Repeated rows get equal rows; null ids are passed on; an empty table gives an empty result. Other
columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from . import labelled
from .frames import arrow_map
from .textkit import slices, text_buffers, xxh64

BUCKETS = 1 << 20
FEATURES = 4096
#: The least likelihood ratio statistic of a feature: about one false feature in a hundred thousand.
EVIDENCE = 20.0
GRADES = 3
FOLDS = 2
#: Weight decay, steps of the fit.
DECAY = 1e-5
ROUNDS = 600

_WORD = np.zeros(256, bool)
for _low, _high in ((48, 58), (97, 123), (0x80, 0x100)):
    _WORD[_low:_high] = True


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word of a column of lower-cased text."""
    data, offsets = text_buffers(column)
    inside = _WORD[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = offsets[:-1] < offsets[1:]
        heads, tails = offsets[:-1][full], offsets[1:][full] - 1
        first[heads], last[tails] = inside[heads], inside[tails]
    starts = np.flatnonzero(first)
    buckets = (xxh64(data, starts, np.flatnonzero(last) + 1) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return np.searchsorted(offsets, starts, side="right") - 1, buckets


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        row, bucket = features(batch.column("text"))
        pairs = np.unique(row * BUCKETS + bucket)
        label = np.asarray(batch.column("label"))[pairs // BUCKETS] > 0
        yield pa.RecordBatch.from_arrays([pa.array(pairs % BUCKETS), pa.array(label.astype(np.int64)), pa.array((~label).astype(np.int64))], ["bucket", "toxic", "clean"])


def _counts(batches: Iterator[pa.RecordBatch], chosen: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        row, feature, count = _tallies(batch.column("text"), chosen)
        bounds = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, pa.array(v, pa.int32())) for v in (feature, count)]
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("fold"), *lists], ["label", "fold", "features", "counts"])


def _tallies(column: pa.Array, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count) of the features in a column, by row; a feature is a place in ``chosen``."""
    row, bucket = features(column)
    at = np.searchsorted(chosen, bucket)
    on = np.flatnonzero(np.append(chosen, -1)[at] == bucket)
    pair, count = np.unique(row[on] * max(len(chosen), 1) + at[on], return_counts=True)
    return pair // max(len(chosen), 1), pair % max(len(chosen), 1), count


class Model:
    """chosen: the sorted buckets that are features; weights; thresholds."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.chosen, self.weights, self.thresholds = chosen, weights, thresholds


def _log_ratio(a, b, n1, n0):
    """Twice the log likelihood ratio of frequencies a of n1 and b of n0 against one frequency, for those with a the larger."""
    term = lambda k, n: F.when(k > 0, k * F.log(k / n)).otherwise(0.0) + F.when(k < n, (n - k) * F.log((n - k) / n)).otherwise(0.0)
    each = term(a, F.lit(float(n1))) + term(b, F.lit(float(n0)))
    return F.when(a * float(n0) > b * float(n1), 2 * (each - term(a + b, F.lit(float(n1 + n0))))).otherwise(0.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    sample = staged(labelled.sample(docs, labels, F.col("toxic"), id_col, text_col).withColumn("text", F.lower("text")), "labelled")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy((F.col("label") > 0).alias("toxic")).count().collect()}
    nothing = Model(np.zeros(0, np.int64), np.zeros(0), np.full(GRADES, np.inf))
    if len(sizes) < 2:
        return nothing
    by = arrow_map(sample.select("text", "label"), _frequencies, "bucket long, toxic long, clean long")
    by = by.groupBy("bucket").agg(F.sum("toxic").cast("double").alias("a"), F.sum("clean").cast("double").alias("b"))
    by = by.withColumn("evidence", _log_ratio(F.col("a"), F.col("b"), sizes[True], sizes[False])).filter(F.col("evidence") >= EVIDENCE)
    chosen = np.array(sorted(r["bucket"] for r in by.orderBy(F.desc("evidence"), "bucket").limit(FEATURES).collect()), np.int64)
    if not len(chosen):
        return nothing
    fold = F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(FOLDS)).cast("int").alias("fold")
    rows = arrow_map(sample.select("text", "label", fold), _counts, "label int, fold int, features array<int>, counts array<int>", chosen).toArrow()
    toxic, fold = np.asarray(rows.column("label")) > 0, np.asarray(rows.column("fold"))
    lists = [rows.column(c).combine_chunks() for c in ("features", "counts")]
    row = np.repeat(np.arange(len(toxic)), np.asarray(lists[0].value_lengths()))
    column, x = np.asarray(lists[0].flatten()), 1 + np.log(np.asarray(lists[1].flatten()))
    return Model(chosen, *_regression(row, column, x, _grades(row, column, x, toxic, fold, len(chosen)), len(chosen)))


def _grades(row: np.ndarray, column: np.ndarray, x: np.ndarray, toxic: np.ndarray, fold: np.ndarray, width: int) -> np.ndarray:
    """0 for clean documents; of a fold's toxic documents 1 to GRADES, by quantiles of the scores that the other folds' fit gives them."""
    grade = np.zeros(len(toxic), int)
    for k in range(FOLDS):
        seen = fold != k
        w, _ = _regression(row, column, x, toxic.astype(int), width, 1, seen)
        score = np.bincount(row, w[column] * x, minlength=len(toxic))
        own = np.flatnonzero((fold == k) & toxic)
        if len(own):
            steps = np.quantile(score[own], np.arange(1, GRADES) / GRADES)
            grade[own] = 1 + (score[own, None] > steps).sum(axis=1)
    return grade


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _regression(
    row: np.ndarray, column: np.ndarray, x: np.ndarray, grade: np.ndarray, width: int, grades: int = GRADES, seen: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the least penalised loss of P(grade >= k), summed over k, on the documents ``seen`` (Adam, full batches)."""
    weight = np.ones(len(grade)) if seen is None else seen.astype(float)
    weight /= max(weight.sum(), 1)
    n = len(grade)
    over = (grade[:, None] >= np.arange(1, grades + 1)).astype(float)
    # thresholds as a first one and the logs of the steps up from it, so that they stay in order
    w, t = np.zeros(width), np.concatenate([[2.0], np.zeros(grades - 1)])
    m, v = np.zeros(width + grades), np.zeros(width + grades)
    for step in range(1, ROUNDS + 1):
        score = np.bincount(row, w[column] * x, minlength=n)
        rise = np.exp(t[1:])
        error = (_sigmoid(score[:, None] - np.concatenate([[t[0]], t[0] + np.cumsum(rise)])) - over) * weight[:, None]
        gw = np.bincount(column, error.sum(axis=1)[row] * x, minlength=width) + DECAY * w / grades
        gk = -error.sum(axis=0)
        gt = np.concatenate([[gk.sum()], np.cumsum(gk[::-1])[::-1][1:] * rise])
        g = np.concatenate([gw, gt])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, t = w - move[:width], t - move[width:]
    return w, np.concatenate([[t[0]], t[0] + np.cumsum(np.exp(t[1:]))])


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        n = batch.num_rows
        over = np.zeros((n, GRADES))
        if len(model.chosen):
            row, feature, count = _tallies(batch.column("text"), model.chosen)
            score = np.bincount(row, model.weights[feature] * (1 + np.log(count)), minlength=n)
            over = _sigmoid(score[:, None] - model.thresholds)
        severity = np.round(over.sum(axis=1), 6) + 0.0
        grade = (over >= 0.5).sum(axis=1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(severity), pa.array(grade), pa.array(grade > 0)], ["id", "severity", "grade", "toxic"])


def severity(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, severity, grade, toxic) of every row: expected grade, the highest grade that is likelier than not, whether there is one."""
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(f"`{id_col}`").alias("id"), F.lower(F.col(f"`{text_col}`").cast("string")).alias("text"))
    return arrow_map(source, _score, f"id {kind}, severity double, grade int, toxic boolean", model).withColumnRenamed("id", id_col)


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on ``labels`` of ``df`` and give every row its severity."""
    return severity(df, fit(df, labels, id_col, text_col), id_col, text_col)
