"""The bounded sample of labelled documents that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a fit sees at most; those with the smallest hashes of their ids.
SAMPLE = 20_000


def sample(docs: DataFrame, labels: DataFrame, label: Column, id_col: str = "doc_id", text_col: str = "text", size: int = SAMPLE) -> DataFrame:
    """(id, text, label) of the labelled documents in the sample.

    A document labelled more than once has the highest of its labels; null labels are none. The
    sample's ids are at most ``size`` rows of two numbers, which is what makes them safe to broadcast.
    """
    chosen = (
        labels.select(F.col(f"`{id_col}`").cast("long").alias("labelled_id"), label.cast("int").alias("label"))
        .dropna()
        .groupBy("labelled_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("labelled_id"), "labelled_id")
        .limit(size)
    )
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), F.col("id") == F.col("labelled_id")).select("id", "text", "label")
