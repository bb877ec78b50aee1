"""The corpus pipeline: STAGES over documents, each a DataFrame that is written and read again.

Every stage but the last returns the columns of documents. A text that a stage changes keeps its
doc_id, and n_chars follows it. The mix repeats a document as often as it takes it. The last stage
returns for each document left doc_id, n_tokens and digests of its ids and of the text they give.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import mixing, quality, sentencepieces, simhash, substring
from siltstone.session import spread, staged


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws; the labels are those of sf_dir."""
    return quality.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8), that with the smallest id."""
    return simhash.drop_near_duplicates(docs, shingle=5, similarity=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that start in an earlier document; texts that lose none stay as they are."""
    return substring.strip_substrings(docs, chars_col="n_chars" if "n_chars" in docs.columns else None)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources at their target weights."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of what is left, and the text they decode to, as digests."""
    return sentencepieces.digest(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mix", source_mix),
    ("sentencepiece", encode),
]

#: The classifier and the library's segmentation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
