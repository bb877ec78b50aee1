"""Small helpers on DataFrames that the operators share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def arrow_map(
    df: DataFrame, function: Callable[..., Iterator[pa.RecordBatch]], schema: T.StructType | str, *args, **kwargs
) -> DataFrame:
    """``df.mapInArrow`` with further arguments for ``function(batches, *args)``."""
    return df.mapInArrow(functools.partial(_call, function, args, kwargs), schema)


def _call(function, args, kwargs, batches):
    try:
        yield from function(batches, *args, **kwargs)
    finally:  # workers are used again: what a task has freed goes back to the machine
        pa.default_memory_pool().release_unused()
        _trim()


def _trim() -> None:
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns whose names an operator is about to give (case counts as Spark has it)."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def text_key(text: Column) -> Column:
    """What tells rows of one id apart: a hash of the text, 0 for a null."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.xxhash64(text.cast("string")))


def without_rows(df: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` less the rows whose id and text are in ``gone`` (gone_id, gone_key); rows without an id stay."""
    same = (F.col(f"`{id_col}`").cast("long") == F.col("gone_id")) & (text_key(F.col(f"`{text_col}`")) == F.col("gone_key"))
    return df.join(gone, same, "left_anti")


def once(df: DataFrame, repeated: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` with one row left of each id and text in ``repeated`` (gone_id, gone_key)."""
    if repeated.isEmpty():
        return df
    marked = df.withColumns({"siltstone_id": F.col(f"`{id_col}`").cast("long"), "siltstone_key": text_key(F.col(f"`{text_col}`"))})
    same = (F.col("siltstone_id") == F.col("gone_id")) & (F.col("siltstone_key") == F.col("gone_key"))
    some = marked.join(repeated, same, "left_semi")
    # of rows that differ in other columns the first in the order of what they hold
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    first = some.groupBy("siltstone_id", "siltstone_key").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return marked.join(repeated, same, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns]).union(first)


def record_batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) if not isinstance(v, pa.Array) else v for v in columns.values()], list(columns))
