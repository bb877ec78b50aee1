"""Where results go: ledgers, manifests, token files, staged swaps."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tsv_cell


def write_tsv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Tab-separated with a header; tabs and line ends in cells become spaces. With an order, files are ranges of it."""
    texts = {f.name: tsv_cell(F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    out = df.withColumns(texts) if texts else df
    if order:
        out = out.repartitionByRange(*order).sortWithinPartitions(*order)
    out.write.mode("overwrite").option("sep", "\t").option("header", "true").option("quote", "").option("emptyValue", "").csv(path)


def manifest(ledger: DataFrame, fingerprint: str, **settings) -> str:
    """One JSON document: totals by status and source, and how the build was set."""
    by = ledger.groupBy("status", "source").agg(F.count("*").alias("documents"), F.sum("chars").alias("chars")).orderBy("status", "source").collect()
    return json.dumps({"fingerprint": fingerprint, "settings": settings, "totals": [r.asDict() for r in by]}, sort_keys=True)


def write_tokens(df: DataFrame, path: str) -> None:
    """(split, source, ord, ids) as Parquet by split and source, in order within files."""
    df.sortWithinPartitions("split", "source", "ord").write.mode("overwrite").partitionBy("split", "source").parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Add rows to a table whose columns may grow; read it with mergeSchema."""
    df.write.mode("append").parquet(path)


def read_grown(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def swap(df: DataFrame, path: str, least: int = 1) -> int:
    """Write aside, then take the place of what is at ``path``; fewer than ``least`` rows never do."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    aside, old = hadoop.Path(path + ".part"), hadoop.Path(path + ".old")
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(path + ".part")
    n = spark.read.parquet(path + ".part").count()
    if n < least:
        fs.delete(aside, True)
        return 0
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    if not fs.rename(aside, target):
        fs.rename(old, target)
        raise OSError(f"{path} could not be replaced")
    fs.delete(old, True)
    return n


def binary_ids(batches: Iterator, folder: str):
    """For mapInArrow over (ids): write each partition's ids as little-endian 32-bit integers, give (file, n)."""
    import uuid

    import numpy as np
    import pyarrow as pa
    import pyarrow.fs as pafs

    fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
    fs.create_dir(root, recursive=True)
    name, n = f"{root}/{uuid.uuid4().hex}.bin", 0
    with fs.open_output_stream(name) as out:
        for batch in batches:
            ids = np.asarray(batch.column("ids").flatten()).astype("<u4")
            out.write(ids.tobytes())
            n += len(ids)
    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["file", "n"])
