"""Train and validation by near-duplicate group, and what leaks between them (SP01-SP06, J07-J10, A14)."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType
from pyspark.sql.window import Window

from ..functions import runs
from ..functions.hashing import unit


def groups(df: DataFrame, seed: str = "58") -> DataFrame:
    """(source, root, chars, size, first, cross, u) of df(source, id, root, root_source, chars): one row a group."""
    by = df.groupBy("source", "root").agg(F.sum("chars").alias("chars"), F.count("*").alias("size"), F.min("id").alias("first"), F.first("root_source").alias("root_source"))
    spread = df.groupBy("root").agg((F.count_distinct("source") > 1).alias("cross"))
    return by.join(spread, "root").withColumn("u", unit(seed, "split", F.concat_ws(":", "root_source", "root")))


def group_split(
    df: DataFrame, fraction: float = 0.05, most: int = 20_000_000, share: float = 0.25, seed: str = "58", settled: DataFrame | None = None
) -> DataFrame:
    """(source, root, split): whole groups go to validation, in the order of their unit, while a source's budget lasts.

    Groups that span sources or are too large a part of the budget train; one that would overfill it
    is passed over. ``settled`` (root, split) fixes groups first, and those of validation take their
    part of the budget. The fold is sequential by definition: a task has the groups of one source that
    can enter at all (small enough, of one source, not settled, before the budget is full), a few
    numbers each. A null source is a source of its own.
    """
    g = groups(df, seed)
    g = g.withColumn("fixed", F.lit(None).cast("string")) if settled is None else g.join(settled.withColumnRenamed("split", "fixed"), "root", "left")
    totals = g.groupBy("source").agg(
        F.least(F.sum("chars") * fraction, F.lit(float(most))).alias("budget"),
        F.count("*").alias("n"),
        F.sum(F.when(F.col("fixed") == "val", F.col("chars")).otherwise(0)).cast("double").alias("start"),
    )
    g = g.join(totals, "source")
    able = F.col("fixed").isNull() & ~F.col("cross") & (F.col("chars") <= share * F.col("budget")) & (F.col("n") >= 2)
    offered = g.filter(able).select("source", "root", "chars", "budget", "start", "u", "first")
    # groups of up to a tenth of the budget always fit while there is budget: once these fill it, nothing later enters
    bucket = F.floor(F.col("u") * BUCKETS)
    small = F.when(F.col("chars") <= 0.1 * F.col("budget"), F.col("chars")).otherwise(0)
    sums = offered.groupBy("source", bucket.alias("bucket")).agg(F.sum(small).alias("chars"), F.first("budget").alias("budget"))
    up = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = sums.withColumn("up_to", F.sum("chars").over(up)).filter(F.col("up_to") >= F.col("budget")).groupBy("source").agg(F.min("bucket").alias("last"))
    offered = offered.join(last, "source", "left").filter(F.col("last").isNull() | (bucket <= F.col("last"))).drop("last")
    chosen = offered.groupBy("source").applyInPandas(_fold, "source string, root long, val boolean")
    out = g.select("source", "root", "fixed").join(chosen, ["source", "root"], "left")
    return out.select("source", "root", F.coalesce("fixed", F.when(F.col("val"), "val")).alias("s")).select("source", "root", F.coalesce("s", F.lit("train")).alias("split"))


#: Buckets of a group's unit, by which the part of a source that can enter is found.
BUCKETS = 4096


def _fold(groups: pd.DataFrame) -> pd.DataFrame:
    """The groups of one source that are taken, in the order of their units."""
    groups = groups.sort_values(["u", "first"], kind="stable")
    used, budget, taken = float(groups["start"].iloc[0]), float(groups["budget"].iloc[0]), []
    for root, chars in zip(groups["root"], groups["chars"], strict=True):
        if used >= budget:
            break
        if used + chars <= budget * 1.1:
            used += chars
            taken.append(root)
    source = pd.Series([groups["source"].iloc[0]] * len(taken), dtype=object)
    return pd.DataFrame({"source": source, "root": pd.Series(taken, dtype="int64"), "val": pd.Series([True] * len(taken), dtype=bool)})


def previous_split(df: DataFrame, earlier: DataFrame) -> DataFrame:
    """(root, split): what an earlier build made of a cluster, known by (source, id) or by content; training wins.

    df(source, id, key, root), earlier(source, id, key, split). The either-or is two equi-joins.
    """
    a = earlier.select(F.col("source"), F.translate("id", "\\", "/").alias("id"), (F.col("split") == "train").alias("train"))
    b = earlier.select("key", (F.col("split") == "train").alias("train"))
    named = df.select("root", "source", F.translate("id", "\\", "/").alias("id")).join(a, ["source", "id"]).select("root", "train")
    same = df.select("root", "key").join(b, "key").select("root", "train")
    return named.union(same).groupBy("root").agg(F.when(F.bool_or("train"), "train").otherwise("val").alias("split"))


def ngram_hashes(df: DataFrame, id_col: str, text_col: str, n: int = 13, keep: int = 16) -> DataFrame:
    """(id, h): the distinct 52-bit hashes of runs of n words that fall in one of ``keep`` classes."""

    @F.arrow_udf(ArrayType(LongType()))
    def hashed(text: pa.Array) -> pa.Array:
        return runs.distinct_hashes(text, n, keep)

    return df.select(F.col(id_col).alias("id"), F.explode(hashed(F.concat(F.lower(F.col(text_col)), F.lit("\n")))).alias("h"))


def overlap(held_out: DataFrame, training: DataFrame, at_least: int = 5) -> DataFrame:
    """(id, sampled, matched, overlap) of held-out documents with enough sampled n-grams: the share that training has too."""
    known = training.select("h").distinct().withColumn("seen", F.lit(1))
    by = held_out.join(known, "h", "left").groupBy("id").agg(F.count("*").alias("sampled"), F.count("seen").alias("matched"))
    return by.filter(F.col("sampled") >= at_least).withColumn("overlap", F.col("matched") / F.col("sampled"))


def moved_to_train(df: DataFrame, leaks: DataFrame, settled: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """df(id, root, split) with the clusters of leaking validation documents moved, unless settled (root)."""
    roots = df.join(leaks.filter(F.col("overlap") >= least).select("id"), "id", "left_semi").select("root").distinct()
    if settled is not None:
        roots = roots.join(settled, "root", "left_anti")
    marked = df.join(roots.withColumn("leaks", F.lit(True)), "root", "left")
    return marked.withColumn("moved", F.coalesce(F.col("leaks") & (F.col("split") == "val"), F.lit(False))).withColumn(
        "split", F.when(F.col("moved"), "train").otherwise(F.col("split"))
    ).drop("leaks")


def parity(df: DataFrame, by: str, order: str) -> DataFrame:
    """``df`` with held_out: every second row of each group."""
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumn("held_out", (F.row_number().over(w) - 1) % 2 == 1)
