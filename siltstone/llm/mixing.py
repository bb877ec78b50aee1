"""Mixing sources to target weights by hash-threshold histograms.

Every row has a 60-bit hash of its id. A source whose target is r times its size takes all of its
rows floor(r) times, and once more those below a threshold of the hash, set so that their words come
as near to the rest as whole rows allow. The threshold is found without sorting rows: words are
summed by source and hash bucket, the bucket in which the budget runs out is found on those sums,
and only that bucket's rows are summed again, by finer buckets nested in it. Rows are then filtered
by comparing their own hash with their source's threshold.

Nulls: a null text has no words; a null source is a source of its own, the last in order; null ids
hash alike. Rows of one id and source have one hash and share their fate. Sources without words have
the target 0. An empty table gives an empty result. mix() replaces columns named like an output; mixed() has
no outputs of its own and passes on every column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import staged
from .frames import without

WEIGHTS = (3, 1, 2)
#: The mix's words as a share of all words, and the most a source is taken.
SHARE = 1.5
MOST = 2
#: Bits of the hash that each nested histogram adds; the last look is at whole hashes.
LEVELS = (12, 12, 12)
HASH_BITS = 60
WORD = r"[^\x20\x09-\x0D]+"


def _key(source: Column) -> Column:
    """A source's name that is never null, so that it can be joined on."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _hash(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _measured(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``df`` with siltstone_key, siltstone_size and siltstone_h: its source's key, its words, its hash."""
    words = F.regexp_count(F.col(f"`{text_col}`").cast("string"), F.lit(WORD))
    return df.withColumns(
        {
            "siltstone_key": _key(F.col(f"`{source_col}`")),
            "siltstone_size": F.coalesce(words, F.lit(0)).cast("long"),
            "siltstone_h": _hash(F.col(f"`{id_col}`")),
        }
    )


def _rows(measured: DataFrame) -> DataFrame:
    return measured.select(F.col("siltstone_key").alias("key"), F.col("siltstone_size").alias("size"), F.col("siltstone_h").alias("h"))


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(key, source_size, target) of each source of ``rows`` (key, size, h).

    Sources stand in code-point order and weigh in turn. The sources whose cap lies below their
    share are those with the least cap a weight; going up that order, each is capped while what
    is left, shared by the weights left, would exceed its cap. The first that isn't sets the share.
    """
    by = rows.groupBy("key").agg(F.sum("size").alias("source_size"))
    # the windows over all sources see one row a source
    named = Window.orderBy((F.col("key") == "").cast("int"), "key")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("w", w).withColumn("cap", F.col("source_size") * float(most))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    up = Window.orderBy(F.col("cap") / F.col("w"), "key").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("all_size", F.sum("source_size").over(everything)).withColumn("all_w", F.sum("w").over(everything))
    by = by.withColumn(
        "level",
        (F.col("all_size") * share - F.coalesce(F.sum("cap").over(up), F.lit(0.0)))
        / (F.col("all_w") - F.coalesce(F.sum("w").over(up), F.lit(0.0))),
    ).withColumn("free", F.col("cap") > F.col("level") * F.col("w"))
    # of those that are free the first in that order
    free = F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), F.col("key"), F.col("level")))
    by = by.withColumn("settled", F.min(free).over(everything)["level"])
    return by.select(
        "key",
        "source_size",
        F.when(F.col("settled").isNull() | (F.col("cap") <= F.col("settled") * F.col("w")), F.col("cap"))
        .otherwise(F.col("settled") * F.col("w"))
        .alias("target"),
    )


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(key, base, below): each source's rows are taken base times, and once more if h < below.

    Each level adds to the known prefix of the boundary hash. What lies before the boundary is
    carried as a sum, so every level reads only the rows of one bucket for each source.
    """
    state = goals.filter("source_size > 0").select(
        "key",
        F.floor(F.col("target") / F.col("source_size")).cast("long").alias("base"),
        (F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")).alias("rest"),
        F.lit(0).cast("long").alias("prefix"),
        F.lit(0.0).alias("done"),
    )
    state, used = staged(state, "budgets"), 0
    running = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    for bits in (*LEVELS, HASH_BITS - sum(LEVELS)):
        left = HASH_BITS - used - bits
        inside = rows.join(state.select("key", "prefix"), "key").filter(F.shiftright("h", HASH_BITS - used) == F.col("prefix"))
        sums = inside.groupBy("key", F.shiftright("h", left).alias("bucket")).agg(F.sum("size").alias("size"))
        sums = sums.join(state, "key").withColumn("before", F.col("done") + F.coalesce(F.sum("size").over(running), F.lit(0)))
        # the last bucket that begins within the budget; one that has no words can't be it, but the first
        at = F.max(F.when((F.col("before") <= F.col("rest")), F.struct("bucket", "before", "size")))
        found = sums.groupBy("key", "base", "rest").agg(at.alias("at"))
        state = staged(
            found.select("key", "base", "rest", F.col("at.bucket").alias("prefix"), F.col("at.before").cast("double").alias("done"), F.col("at.size").alias("last")),
            f"level{used}",
        )
        used += bits
    nearer = 2 * (F.col("rest") - F.col("done")) > F.col("last")
    below = F.when(F.col("rest") > 0, F.col("prefix") + F.when(nearer, 1).otherwise(0)).otherwise(0)  # empty rows too are taken base times then
    return state.select("key", "base", below.cast("long").alias("below"))


def _taken(measured: DataFrame, rows: DataFrame, weights, share, most) -> DataFrame:
    """``measured`` with siltstone_source_size, siltstone_target and siltstone_copies, as the mix planned on ``rows`` has them."""
    goals = staged(targets(rows, weights, share, most), "targets")
    # staged, so that its size is known when it is joined: a short table is sent to the rows, and they stay where they are
    plan = goals.join(thresholds(rows, goals), "key", "left")
    plan = staged(plan.select(*[F.col(c).alias(f"siltstone_plan_{c}") for c in plan.columns]), "plan")
    joined = measured.join(plan, F.col("siltstone_key") == F.col("siltstone_plan_key"), "left")
    once_more = F.when(F.col("siltstone_h") < F.col("siltstone_plan_below"), 1).otherwise(0)
    return joined.select(
        *[F.col(f"`{c}`") for c in measured.columns],
        F.coalesce("siltstone_plan_source_size", F.lit(0)).cast("long").alias("siltstone_source_size"),
        F.coalesce("siltstone_plan_target", F.lit(0.0)).alias("siltstone_target"),
        F.coalesce(F.col("siltstone_plan_base") + once_more, F.lit(0)).cast("long").alias("siltstone_copies"),
    )


def _planned(df: DataFrame, id_col: str, text_col: str, source_col: str, weights, share, most) -> DataFrame:
    measured = _measured(df, id_col, text_col, source_col)
    return _taken(measured, staged(_rows(measured), "sizes"), weights, share, most)


def _outputs() -> list[Column]:
    names = ("size", "source_size", "target", "copies")
    return [*[F.col(f"siltstone_{n}").alias(n) for n in names], (F.col("siltstone_size") * F.col("siltstone_copies")).alias("taken")]


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """``df`` with size, source_size, target, copies and taken = size * copies for every row."""
    kept = without(df, "size", "source_size", "target", "copies", "taken").columns
    return _planned(df, id_col, text_col, source_col, weights, share, most).select(*[F.col(f"`{c}`") for c in kept], *_outputs())


def mixed(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """The mix itself: each row of ``df`` as often as it is taken, with all columns of ``df`` and no other."""
    out = _planned(df, id_col, text_col, source_col, weights, share, most)
    out = out.withColumn("siltstone_copy", F.explode(F.array_repeat(F.lit(0), F.col("siltstone_copies").cast("int"))))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken) of every row; texts are read once."""
    measured = _measured(df, id_col, text_col, source_col)
    narrow = staged(measured.select(F.col(f"`{id_col}`"), "siltstone_key", "siltstone_size", "siltstone_h"), "sizes")
    return _taken(narrow, _rows(narrow), WEIGHTS, SHARE, MOST).select(F.col(f"`{id_col}`"), *_outputs()).drop("copies")


ORACLE_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS s,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM rows GROUP BY source
), levels AS (
  SELECT *, 2.0::DOUBLE * s AS cap,
         (sum(s) OVER () * 1.5::DOUBLE - coalesce(sum(2.0::DOUBLE * s) OVER up, 0))
         / (sum(w) OVER () - coalesce(sum(w) OVER up, 0)) AS lv
  FROM sources
  WINDOW up AS (ORDER BY 2.0::DOUBLE * s / w, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS FIRST) AS rn FROM levels
), free AS (
  SELECT min_by(lv, rn) FILTER (WHERE cap > lv * w) AS lv FROM ranked
), settled AS (
  SELECT source, s, CASE WHEN free.lv IS NULL OR cap <= free.lv * w THEN cap ELSE free.lv * w END AS target
  FROM ranked, free
), hashes AS (
  SELECT r.source, r.h, sum(r.size)::BIGINT AS g FROM rows r GROUP BY r.source, r.h
), running AS (
  SELECT h.source, h.h, h.g, t.s, t.target, floor(t.target / t.s)::BIGINT AS base,
         t.target - floor(t.target / t.s) * t.s AS rest,
         sum(h.g) OVER (PARTITION BY h.source ORDER BY h.h) - h.g AS before
  FROM hashes h JOIN settled t ON h.source IS NOT DISTINCT FROM t.source
), marked AS (
  SELECT source, h, s, target,
         base + CASE WHEN before + g <= rest OR (before <= rest AND 2 * (rest - before) > g) THEN 1 ELSE 0 END AS copies
  FROM running
)
SELECT r.doc_id, r.size, m.s AS source_size, m.target, (r.size * m.copies)::BIGINT AS taken
FROM rows r JOIN marked m ON r.source IS NOT DISTINCT FROM m.source AND r.h = m.h
"""
