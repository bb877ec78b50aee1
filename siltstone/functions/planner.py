"""Planning formulas as Column expressions over a table of model shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Peak learning rates by parameters, between which the logarithms are interpolated.
LR_TABLE = ((1e6, 4.0e-3), (1e7, 2.4e-3), (1e8, 1.2e-3), (1e9, 6.0e-4))
# Half the fitted batch 0.292 C^0.327 of the compute C, between 2^14 and 2^21.
BATCH_SHARE, BATCH_POWER = 0.5 * 0.292, 0.327
VOCABULARY = (4096, 65_536, 20_000_000)


def vocabulary_size(chars: Column) -> Column:
    """The least size up to 20 million characters, twice as much for ten times more, up to the most."""
    least, most, step = VOCABULARY
    grown = least * F.pow(F.lit(2.0), F.floor(F.log10(chars / float(step))) + 1)
    return F.least(F.lit(float(most)), F.when(chars < step, float(least)).otherwise(grown)).cast("long")


def parameters(layers: Column, d: Column, hidden: Column, heads_kv: Column, head: Column, vocabulary: Column) -> Column:
    """Parameters of a dense decoder with tied embeddings and normalised queries and keys."""
    attention = 2 * d * d + 2 * d * heads_kv * head + 2 * d + 2 * head
    return attention * layers + 3 * d * hidden * layers + d + vocabulary * d


def flops_per_token(n: Column, layers: Column, context: Column, d: Column, checkpointing: bool = False) -> Column:
    return (8 if checkpointing else 6) * n + (16 if checkpointing else 12) * layers * context * d


def peak_learning_rate(n: Column) -> Column:
    """Interpolated between the points of the table, held at its ends."""
    x = F.log10(F.greatest(n, F.lit(1)).cast("double"))
    out = F.lit(LR_TABLE[-1][1])
    for (n0, lr0), (n1, lr1) in reversed(list(zip(LR_TABLE, LR_TABLE[1:], strict=False))):
        share = (x - F.log10(F.lit(n0))) / (F.log10(F.lit(n1)) - F.log10(F.lit(n0)))
        inside = F.pow(F.lit(10.0), F.log10(F.lit(lr0)) + (F.log10(F.lit(lr1)) - F.log10(F.lit(lr0))) * share)
        out = F.when(x <= F.log10(F.lit(n1)), inside).otherwise(out)
    return F.when(x <= F.log10(F.lit(LR_TABLE[0][0])), F.lit(LR_TABLE[0][1])).otherwise(out)


def tokens_per_step(n: Column, tokens: Column) -> Column:
    raw = BATCH_SHARE * F.pow(6.0 * F.greatest(n, F.lit(1)) * F.greatest(tokens, F.lit(1)), F.lit(BATCH_POWER))
    return F.least(F.greatest(F.pow(F.lit(2.0), F.bround(F.log2(raw))), F.lit(2.0**14)), F.lit(2.0**21)).cast("long")


def shapes(spark: SparkSession) -> DataFrame:
    """A ladder of shapes with what they cost."""
    rows = spark.range(1, 13).select(F.col("id").alias("k"))
    s = rows.select("k", (F.col("k") * 2).alias("layers"), (F.col("k") * 128).alias("d"))
    s = s.withColumn("n", parameters(F.col("layers"), F.col("d"), F.col("d") * 8 / 3, F.lit(2), F.lit(64), F.lit(32768)).cast("long"))
    return s.select(
        "k", "n",
        flops_per_token(F.col("n"), F.col("layers"), F.lit(2048), F.col("d")).alias("flops"),
        F.round(peak_learning_rate(F.col("n")) * 1e6, 3).alias("lr_millionths"),
        tokens_per_step(F.col("n"), F.col("n") * 20).alias("batch"),
    )


ORACLE_SQL = """
WITH s AS (SELECT k, k * 2 AS layers, k * 128 AS d FROM range(1, 13) t(k)),
p AS (SELECT *, ((2 * d * d + 2 * d * 128 + 2 * d + 128) * layers + 3 * d * (d * 8 / 3) * layers + d + 32768 * d)::BIGINT AS n FROM s)
SELECT k, n, 6 * n + 12 * layers * 2048 * d AS flops,
  round(1e6 * CASE WHEN n <= 1e6 THEN 0.004 WHEN n <= 1e7 THEN pow(10, log10(0.004) + (log10(0.0024) - log10(0.004)) * (log10(n) - 6))
    WHEN n <= 1e8 THEN pow(10, log10(0.0024) + (log10(0.0012) - log10(0.0024)) * (log10(n) - 7))
    WHEN n <= 1e9 THEN pow(10, log10(0.0012) + (log10(0.0006) - log10(0.0012)) * (log10(n) - 8)) ELSE 0.0006 END, 3) AS lr_millionths,
  least(greatest(pow(2, round(log2(0.146 * pow(6.0 * n * n * 20, 0.327)))), 16384), 2097152)::BIGINT AS batch
FROM p
"""
