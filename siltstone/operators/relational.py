"""Joins that Spark has no word for: intervals, as-of, and values in bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """``left`` with the values of the last row of ``right`` at or before each row's time, by keys.

    Both sides are merged in one stream and the last seen values carried on: one shuffle, no join.
    """
    own = left.select("*", F.lit(1).alias("siltstone_side"), F.col(left_time).alias("siltstone_t"), *[F.lit(None).cast(right.schema[v].dataType).alias(f"siltstone_{v}") for v in values])
    other = right.select(
        *[F.col(c) if c in keys else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns],
        F.lit(0).alias("siltstone_side"),
        F.col(right_time).alias("siltstone_t"),
        *[F.col(v).alias(f"siltstone_{v}") for v in values],
    )
    seen = Window.partitionBy(*keys).orderBy("siltstone_t", "siltstone_side").rowsBetween(Window.unboundedPreceding, 0)
    packed = F.struct(*[F.col(f"siltstone_{v}").alias(v) for v in values])
    last = F.last(F.when(F.col("siltstone_side") == 0, packed), ignorenulls=True).over(seen)
    out = own.unionByName(other).withColumn("siltstone_last", last).filter("siltstone_side = 1")
    return out.select(*left.columns, *[F.col(f"siltstone_last.{v}").alias(v) for v in values])


def interval_join(points: DataFrame, spans: DataFrame, point: str, start: str, end: str, width: float) -> DataFrame:
    """Points with each span [start, end) that holds them: an equi-join on bins of ``width``, then the exact test.

    A span is dealt to all the bins it touches, a point to its own, so the join is hashed and no pair
    is looked at outside a bin.
    """
    bins = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width)))
    dealt = spans.filter(F.col(end) > F.col(start)).withColumn("siltstone_bin", bins)
    own = points.withColumn("siltstone_bin", F.floor(F.col(point) / width))
    return own.join(dealt, "siltstone_bin").filter((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("siltstone_bin")


def salted_sum(df: DataFrame, keys: list[str], value: Column, salts: int = 32) -> DataFrame:
    """Sums by keys in two steps, for keys that a few values dominate beyond what partial sums take off."""
    salted = df.withColumn("siltstone_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    return salted.groupBy(*keys, "siltstone_salt").agg(F.sum(value).alias("s")).groupBy(*keys).agg(F.sum("s").alias("total"))


def nearest_by(left: DataFrame, right: DataFrame, by: str, place: str) -> DataFrame:
    """``left`` with nearest, the place of the closest row of ``right`` of the same ``by`` (the smaller of two as close), or null.

    The two tables are laid in one order and each row looks to both sides, so nothing is compared with everything.
    """
    names = left.columns
    a = left.select(F.struct(*names).alias("row"), F.col(by).alias("k"), F.col(place).alias("at"), F.lit(None).cast(dict(right.dtypes)[place]).alias("here"))
    b = right.select(F.lit(None).cast(a.schema["row"].dataType).alias("row"), F.col(by).alias("k"), F.col(place).alias("at"), F.col(place).alias("here"))
    order = Window.partitionBy("k").orderBy("at")
    back = F.last("here", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    ahead = F.first("here", ignorenulls=True).over(order.rangeBetween(0, Window.unboundedFollowing))
    closer = F.when(F.col("back").isNull() | (F.col("ahead") - F.col("at") < F.col("at") - F.col("back")), F.col("ahead")).otherwise(F.col("back"))
    return a.union(b).withColumns({"back": back, "ahead": ahead}).filter("row is not null").select("row.*", closer.alias("nearest"))


#: Bits of an order's value that a block leaves out: how many values of it one window may hold.
BLOCK_BITS = 13


def band_pair_counts(df: DataFrame, by: str, order: str, value: str, width: int) -> DataFrame:
    """(by, pairs): pairs of rows a, b of one ``by`` with a.order < b.order and b.value from a.value to a.value + width; whole numbers.

    Counted, not made: a row counts as a in the band of its own value and as b in those up to ``width``
    below; in a band the a's ahead of each b are a running sum, within blocks of the order and, from
    sums a block, between them. Rows grow as the input times ``width`` + 2 and no window holds more than
    a block's values or the blocks of a band. Groups without a pair are left out, nulls are in none.
    """
    rows = df.select(F.col(by).alias("g"), F.col(order).cast("long").alias("o"), F.col(value).cast("long").alias("v")).dropna()
    alike = rows.groupBy("g", "o", "v").agg(F.count("*").alias("n"))
    dealt = alike.select("g", "o", "n", "v", F.explode(F.sequence(F.col("v") - width, F.col("v"))).alias("band"), F.shiftright("o", BLOCK_BITS).alias("block"))
    dealt = dealt.groupBy("g", "band", "block", "o").agg(F.sum(F.when(F.col("v") == F.col("band"), F.col("n")).otherwise(0)).alias("a"), F.sum("n").alias("b"))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumn("ahead", F.coalesce(F.sum("a").over(before("g", "band", "block").orderBy("o")), F.lit(0)))
    blocks = within.groupBy("g", "band", "block").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.col("ahead") * F.col("b")).alias("own"))
    ahead = F.coalesce(F.sum("a").over(before("g", "band").orderBy("block")), F.lit(0))
    pairs = blocks.withColumn("pairs", F.col("own") + ahead * F.col("b"))
    return pairs.groupBy(F.col("g").alias(by)).agg(F.sum("pairs").alias("pairs")).filter("pairs > 0")
