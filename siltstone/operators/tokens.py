"""Token tables: frequencies, coverage, shares, fingerprints (A11-A13, S15, TK03, TK07, T11)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from ..session import staged


def frequencies(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("token").agg(F.count("*").alias("n"))


def coverage(tokens: DataFrame, top: int) -> DataFrame:
    """(token, n, rank, share) of the most frequent tokens: share is that of all tokens up to this rank."""
    by = frequencies(tokens)
    head = by.orderBy(F.desc("n"), "token").limit(top)
    total = by.agg(F.sum("n").alias("total"))
    w = Window.orderBy(F.desc("n"), "token")  # over the bounded head
    return head.join(F.broadcast(total)).select("token", "n", F.row_number().over(w).alias("rank"), F.round(F.sum("n").over(w) / F.col("total"), 6).alias("share"))


def coverage_ranks(tokens: DataFrame, percents: tuple[int, ...] = (50, 90, 99)) -> DataFrame:
    """(percent, rank): how many of the most frequent tokens cover a share of all.

    Tokens of one count are interchangeable here, so the running sums go over distinct counts.
    """
    counts = frequencies(tokens).groupBy("n").agg(F.count("*").alias("k"))
    w = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    run = counts.withColumns({"ahead": F.coalesce(F.sum("k").over(w), F.lit(0)), "before": F.coalesce(F.sum(F.col("k") * F.col("n")).over(w), F.lit(0))})
    run = run.withColumn("total", F.sum(F.col("k") * F.col("n")).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    each = run.select("*", F.explode(F.array(*[F.lit(p) for p in percents])).alias("percent"))
    need = F.greatest(F.ceil((F.col("total") * F.col("percent") / 100 - F.col("before")) / F.col("n")), F.lit(1))
    return each.filter((F.col("before") + F.col("k") * F.col("n")) * 100 >= F.col("total") * F.col("percent")).groupBy("percent").agg(F.min(F.col("ahead") + need).alias("rank"))


def fingerprint(df: DataFrame, value: Column, order: str) -> DataFrame:
    """One row: the SHA-256 of all values in order."""
    packed = df.select(F.struct(F.col(order).alias("o"), value.alias("v")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return packed.select(F.sha2(F.array_join(F.transform("xs", lambda x: x["v"]), ",").cast("binary"), 256).alias("fingerprint"))


def sample_shares(by: DataFrame, budget: float) -> DataFrame:
    """by(source, chars, weight) with share of the weighted text and the probability that fills ``budget`` characters."""
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = F.col("chars") * F.col("weight") / F.sum(F.col("chars") * F.col("weight")).over(everything)
    return by.withColumn("share", share).withColumn("probability", F.least(F.lit(1.0), budget * F.col("share") / F.col("chars")))


def mix_probabilities(by: DataFrame, alpha: float) -> DataFrame:
    """by(source, n, w) with p in proportion to w * n ** alpha."""
    mass = F.col("w") * F.pow("n", F.lit(alpha))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return by.withColumn("p", mass / F.sum(mass).over(everything))


def piece_category(piece: Column) -> Column:
    """What a vocabulary piece is: space, several words, number, punctuation, symbols, letters."""
    body = F.replace(piece, F.lit("▁"), F.lit(""))
    several = F.size(F.filter(F.split(F.regexp_replace(piece, "^▁+", ""), "▁"), lambda x: x != "")) > 1
    latin = body.rlike(r"^[\x00-\x{24f}]+$")
    return (
        F.when(piece.rlike(r"^<0x[0-9A-F]{2}>$"), "byte fallback")
        .when(piece.isin("\n", "\t") | piece.rlike("^[▁ ]*$"), "whitespace/newline")
        .when(several, "multi-word")
        .when(body.rlike(r"\p{Nd}") & body.rlike(r"^[\p{Nd}.,+-]+$"), "number")
        .when(body.rlike(r"^\p{P}+$"), "punctuation")
        .when(body.rlike(r"^[\p{S}\p{P}]+$"), "symbol/math")
        .when(body.rlike(r"^[\p{L}\p{M}]+$"), F.when(latin, F.when(F.startswith(piece, F.lit("▁")), "word start").otherwise("word piece")).otherwise("non-Latin letters"))
        .otherwise("mixed")
    )


def documents_of(stream: DataFrame, pos: str, token: str, begin: int, part: str | None = None) -> DataFrame:
    """``stream`` with document, the number of begin tokens up to each place; by ``part`` where a stream has parts."""
    begins = F.when(F.col(token) == begin, 1).otherwise(0)
    if part:
        return stream.withColumn("document", F.sum(begins).over(Window.partitionBy(part).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)))
    # by ranges of places, so that no window holds the whole stream
    n = stream.sparkSession.sparkContext.defaultParallelism * 4
    dealt = staged(stream.repartitionByRange(n, pos).withColumn("range_", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("range_").agg(F.sum(begins).alias("own"))
    before = sums.select("range_", (F.sum("own").over(Window.orderBy("range_")) - F.col("own")).alias("before_"))  # a row a range
    within = Window.partitionBy("range_").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(F.broadcast(before), "range_").withColumn("document", F.col("before_") + F.sum(begins).over(within)).drop("range_", "before_")


def byte_lines(df: DataFrame, id_col: str, text_col: str, begin: int = 256, end: int = 257) -> DataFrame:
    """(id, ids, n): a document as begin, the bytes of its text, end: the tokenizer that needs no vocabulary."""
    raw = F.hex(F.encode(F.col(text_col), "UTF-8"))
    bytes_ = F.transform(F.regexp_extract_all(raw, F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("int"))
    ids = F.concat(F.array(F.lit(begin)), bytes_, F.array(F.lit(end)))
    return df.select(F.col(id_col), ids.alias("ids")).withColumn("n", F.size("ids"))


def pair_counts(df: DataFrame, text_col: str) -> DataFrame:
    """(a, b, n): neighbouring lower-cased words over all texts."""
    from ..functions import text as tx

    split = tx.computed(df.select(F.lower(text_col).alias("t")), "w", tx.words(F.col("t"))).filter(F.size("w") >= 2)
    pairs = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return split.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def word_runs(df: DataFrame, text_col: str, n: int, between: str = " ", prefix: str = "") -> DataFrame:
    """``df`` less its text, with runs, distinct and low of the texts that have a run of n lower-cased words.

    How many runs there are, how many differ, and for how many of these unit(prefix and words, joined by
    ``between``) is below a half. No run leaves its row: nothing is shuffled.
    """
    from ..functions import runs, text as tx

    @F.arrow_udf(StructType([StructField(c, LongType()) for c in ("runs", "distinct", "low")]))
    def counted(text: pa.Array) -> pa.Array:
        return runs.run_counts(text, n, ord(between), prefix.encode())

    spaced = F.concat(F.regexp_replace(F.lower(F.col(text_col)), r"[^\p{L}\p{N}_]+", " "), F.lit("\n"))
    kept = [c for c in df.columns if c != text_col]
    return tx.computed(df, "siltstone_runs", counted(spaced)).select(*kept, "siltstone_runs.*").filter("runs > 0")


def length_batches(df: DataFrame, id_col: str, size_col: str, batch: int, mega: int = 50) -> DataFrame:
    """(id, mega, batch): rows fall by hash into mega-batches of about ``mega`` * ``batch`` rows, and by size into batches inside."""
    n = df.count()
    groups = max(1, n // (mega * batch))
    d = df.select(F.col(id_col), F.col(size_col), F.pmod(F.xxhash64(id_col), F.lit(groups)).alias("mega"))
    w = Window.partitionBy("mega").orderBy(size_col, id_col)
    return d.withColumn("batch", F.floor((F.row_number().over(w) - 1) / batch)).drop(size_col)
