"""Structured Streaming over event files: late copies, slots, sessions, first-n state (ST01-ST11)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_folder


def read_events(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """The event table, a file or a folder of files, as a stream of its files; ts as a timestamp, so that watermarks apply."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", name if single else "*.parquet")
    return stream.parquet(folder if single else path).withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over all there is, with its checkpoint in the shared folder, and give its output as a table.

    Output goes to files by batch, so that a restarted query neither loses nor repeats a batch. In
    update or complete mode the last version of each row is what counts, and ``each`` picks it.
    """
    spark = stream.sparkSession
    base = shared_folder(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/part={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    out = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).option("recursiveFileLookup", "true").parquet(f"{base}/out")
    return each(out) if each else out.drop("batch")


def latest_of(*keys: str) -> Callable[[DataFrame], DataFrame]:
    def pick(out: DataFrame) -> DataFrame:
        rest = [c for c in out.columns if c not in (*keys, "batch")]
        return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")

    return pick


def last_of(key: str) -> Callable[[DataFrame], DataFrame]:
    """All rows of a key that the last batch which has it put out; keys may be null."""

    def pick(out: DataFrame) -> DataFrame:
        last = out.groupBy(key).agg(F.max("batch").alias("batch")).withColumnRenamed(key, "siltstone_key")
        same = F.col(key).eqNullSafe(F.col("siltstone_key"))
        return out.withColumnRenamed("batch", "siltstone_batch").join(last, same & (F.col("siltstone_batch") == F.col("batch")), "left_semi").drop("siltstone_batch")

    return pick


def deduplicated(events: DataFrame, *keys: str, late: str = "3 days") -> DataFrame:
    """The first copy of each key; state is kept as long as a late copy may come."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def tumbling(events: DataFrame, width: str, value: Column, late: str = "3 days") -> DataFrame:
    """(start, event_type, n, total) of fixed windows."""
    w = F.window("ts", width)
    by = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return by.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str = "3 days") -> DataFrame:
    by = events.withWatermark("ts", late).groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n"))
    return by.select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str = "3 days") -> DataFrame:
    """(user_id, start, end, n): a user's events with no gap as long as ``gap`` between them."""
    by = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return by.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_n(events: DataFrame, key: str, n: int) -> DataFrame:
    """(key, event_id): the n smallest event ids of each key so far, held in state; null ids come last.

    For update mode: a trigger that changes a key puts out all its rows again, since a later file may
    hold smaller ids. last_of() leaves those of the last trigger.
    """
    kind = events.schema[key].dataType.simpleString()

    def take(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, nulls = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        now, lost = held, nulls
        for pdf in batches:
            now = sorted([*now, *map(int, pdf["event_id"][~pdf["missing"]].nsmallest(n))])[:n]
            lost = min(n, lost + int(pdf["missing"].sum()))
        state.update((now, lost))
        if (now, lost) != (held, nulls):
            rows = [*now, *[None] * min(lost, n - len(now))]
            yield pd.DataFrame({key: [k[0]] * len(rows), "event_id": pd.array(rows, dtype="Int64")})

    # ids stay whole numbers: pandas would make them floats next to nulls
    own = events.select(key, F.coalesce("event_id", F.lit(0)).cast("long").alias("event_id"), F.col("event_id").isNull().alias("missing"))
    return own.groupBy(key).applyInPandasWithState(take, f"{key} {kind}, event_id long", "held array<long>, nulls long", "update", GroupStateTimeout.NoTimeout)


def priced(slots: DataFrame, prices: DataFrame) -> DataFrame:
    """Slots with the price of the period that holds them; one without a price is pending. Stream or table against a table."""
    on = (F.col("start") >= F.col("from")) & (F.col("start") < F.col("to"))
    return slots.join(F.broadcast(prices), on, "left").select("start", "event_type", (F.col("total") * F.col("price")).alias("cost"), F.col("price").isNull().alias("pending"))
