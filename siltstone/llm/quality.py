"""Quality by importance resampling (data selection by hashed n-gram models and Gumbel top-k).

Two bags of hashed n-grams (words and punctuation runs, and pairs of neighbours, in ``BUCKETS``
buckets) are counted: the target's over documents labelled good, of the bounded labelled sample,
and the raw one over all documents. A document's importance is the ratio of its probabilities under
the two: log weight = the sum of the log ratios of its n-grams, over a temperature that is 1 unless
given. Without replacement, k documents are drawn with probabilities as their weights by keeping the
k largest of log weight + Gumbel noise, the noise a hash of the id, so that reruns agree. If k is not
given it is the number of documents whose log ratio is at least the cut that parts the sample's good
and bad documents best.

The k-th largest key is found by nested histograms over staged (id, key) rows, ties by smaller id;
rows of one id and text are one draw, rows of one id with different texts are told apart. Nulls and texts without words have the weight 1 (its log 0).
Null ids hash alike. Without labels of both kinds nothing is learned: all weights are 1 and, unless
k is given, all is kept. One half of the sample, by hash, fits the target and the other sets the
cut, so that the cut is that of documents the target has not seen. An empty table gives an empty result. Columns named like an output are
replaced in select().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from . import labelled
from .frames import arrow_map, text_key, without_rows
from .textkit import mix, slices, text_buffers, xxh64

BUCKETS = 1 << 14
TEMPERATURE = 1.0
#: N-grams of raw text that are added to the target's: where the target says little its ratio is 1.
PRIOR = 4.0 * BUCKETS

_KIND = np.full(256, 2, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
for _low, _high in ((48, 58), (65, 91), (97, 123), (0x80, 0x100)):
    _KIND[_low:_high] = 1


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each row one after the other, and the rows' bounds in them."""
    data, offsets = text_buffers(column)
    kind = _KIND[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[offsets[:-1][offsets[:-1] < len(data)]] = True
    heads = np.flatnonzero(new)
    ends = np.append(heads[1:], len(data))
    solid = kind[heads] > 0
    heads, ends = heads[solid], ends[solid]
    bounds = np.searchsorted(heads, offsets)
    words = xxh64(data, heads, ends)
    n = np.diff(bounds)
    both = n + np.maximum(n - 1, 0)
    out = np.empty(both.sum(), np.int64)
    stops = np.append(0, np.cumsum(both))
    row = np.repeat(np.arange(len(n)), n)
    at = stops[row] + 2 * (np.arange(len(words)) - bounds[row])
    out[at] = (mix(words) % np.uint64(BUCKETS)).astype(np.int64)
    pair = np.flatnonzero(row[1:] == row[:-1]) if len(words) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        two = mix(words[pair] * np.uint64(3) + mix(words[pair + 1]))
    out[at[pair] + 1] = (two % np.uint64(BUCKETS)).astype(np.int64)
    return out, stops


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in slices(batches, "text"):
        total += np.bincount(grams(batch.column("text"))[0], minlength=BUCKETS)
    on = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], ["bucket", "n"])


def counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all of ``texts`` (text); summed on the executors, BUCKETS rows come back."""
    summed = arrow_map(texts.select("text"), _count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS)
    for bucket, n in summed.collect():
        out[bucket] = n
    return out


def _log_ratios(batches: Iterator[pa.RecordBatch], ratio: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        buckets, stops = grams(batch.column("text"))
        total = np.append(0.0, np.cumsum(ratio[buckets]))
        own = np.round(total[stops[1:]] - total[stops[:-1]], 6)
        rest = [(c, batch.column(c)) for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[c for _, c in rest], pa.array(own + 0.0)], [*[c for c, _ in rest], "log_ratio"])


class Model:
    """ratio: the log ratio of each bucket; cut: the least log ratio of a document that counts as good."""

    def __init__(self, ratio: np.ndarray, cut: float) -> None:
        self.ratio, self.cut = ratio, cut


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The models of target and raw text. The raw counts are of all documents, the target's of half the labelled sample."""
    half = F.pmod(F.xxhash64(F.lit("half"), "id"), F.lit(2))
    chosen = staged(labelled.sample(docs, labels, F.col("quality"), id_col, text_col).withColumn("half", half), "labelled")
    seen = {(r["half"], r["label"] > 0) for r in chosen.select("half", "label").distinct().collect()}
    if not {(0, True), (1, True), (1, False)} <= seen:
        return Model(np.zeros(BUCKETS), -1.0)
    raw = counts(docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))) + 1
    raw /= raw.sum()
    target = counts(chosen.filter("label > 0 and half = 0"))
    ratio = np.log((target + PRIOR * raw) / (target.sum() + PRIOR) / raw)
    rows = arrow_map(chosen.filter("half = 1").drop("half"), _log_ratios, "id long, label int, log_ratio double", ratio).select("label", "log_ratio").toArrow()
    return Model(ratio, _cut(np.asarray(rows.column("log_ratio")), np.asarray(rows.column("label")) > 0))


def _cut(scores: np.ndarray, good: np.ndarray) -> float:
    """Half way between the two scores next to the cut with the fewest errors, as shares of their kinds."""
    order = np.argsort(scores, kind="stable")
    scores, good = scores[order], good[order]
    lost = np.append(0, np.cumsum(good)) / max(good.sum(), 1)
    left = (np.append(0, np.cumsum(~good))[-1] - np.append(0, np.cumsum(~good))) / max((~good).sum(), 1)
    at = int(np.argmin(lost + left))
    if at == 0:
        return float(scores[0]) - 1
    if at == len(scores):
        return float(scores[-1])
    return float(scores[at - 1] + scores[at]) / 2


def scored(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", temperature: float = TEMPERATURE) -> DataFrame:
    """(id, text_key, log_ratio, log_weight, key) of every row."""
    text = F.col(f"`{text_col}`").cast("string")
    source = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_key(text).alias("text_key"), text.alias("text"))
    out = arrow_map(source, _log_ratios, "id long, text_key long, log_ratio double", model.ratio)
    unit = (F.pmod(F.xxhash64(F.lit("gumbel"), "id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    weight = F.col("log_ratio") / float(temperature)
    return out.withColumn("log_weight", weight).withColumn("key", F.round(weight - F.log(-F.log(unit)), 6))


def kth_largest(rows: DataFrame, k: int) -> tuple[float, int] | None:
    """The (key, id) of the k-th row in order of key, largest first, then id; None if there are fewer.

    Histograms of 4,096 bins between the least and the largest key, nested in the bin that holds
    the row, until a bin has one key; then the same for the ids. What comes back is a few numbers.
    """
    if k <= 0:
        return None
    found: list[float] = []
    for column, sign in (("key", -1), ("id", 1)):
        value = (F.col(column) * sign).cast("double") if column == "key" else F.coalesce(F.col(column), F.lit(-1))
        rows = rows.withColumn("v", value)
        while True:
            low, high, n = rows.agg(F.min("v"), F.max("v"), F.count("*")).first()
            if n < k:
                return None
            if low == high:
                break
            bin_of = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(float(high - low) / 4096)), F.lit(4095))
            sums = sorted(tuple(r) for r in rows.groupBy(bin_of.alias("bin")).count().collect())
            for at, size in sums:
                if size >= k:
                    break
                k -= size
            rows = rows.filter(bin_of == at)
        found.append(low * sign)
        rows = rows.drop("v")
    return found[0], int(found[1])


def _drawn(df: DataFrame, labels: DataFrame, k: int | None, id_col: str, text_col: str, temperature: float) -> DataFrame:
    """(id, text_key, log_weight, key, kept) of every row of ``df``: kept marks the k drawn."""
    model = fit(df, labels, id_col, text_col)
    rows = staged(scored(df, model, id_col, text_col, temperature), "scores")
    if k is None:
        k = rows.filter(F.col("log_ratio") >= model.cut).count()
    last = kth_largest(rows.select("key", "id"), k)
    own = F.coalesce(F.col("id"), F.lit(-1))
    kept = F.lit(k > 0) if last is None else (F.col("key") > last[0]) | ((F.col("key") == last[0]) & (own <= last[1]))
    return rows.select("id", "text_key", F.round("log_weight", 6).alias("log_weight"), "key", kept.alias("kept"))


def select(
    df: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text", temperature: float = TEMPERATURE
) -> DataFrame:
    """(id, log_weight, key, kept) of every row of ``df``: kept marks the k drawn."""
    out = _drawn(df, labels, k, id_col, text_col, temperature)
    return out.select(F.col("id").alias(id_col), "log_weight", "key", "kept")


def reject(
    df: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text", temperature: float = TEMPERATURE
) -> DataFrame:
    """``df`` without the rows that are not drawn; rows without an id stay."""
    gone = _drawn(df, labels, k, id_col, text_col, temperature).filter(~F.col("kept"))
    return without_rows(df, gone.select(F.col("id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct(), id_col, text_col)
