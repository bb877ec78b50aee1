"""Decisions on documents: ordered reasons, first copies, lines, small predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions.hashing import content_key
from ..session import staged


def reason(text: Column, min_chars: int = 200, head: Column | None = None, english: bool = True) -> Column:
    """The first reason to drop a cleaned text, in the fixed order; null if there is none. Null text is 'missing_text'."""
    return (
        F.when(text.isNull(), "missing_text")
        .when(~tx.looks_english(text, head=head) if english else F.lit(False), "not_english")
        .when(tx.replacement_ratio(text) > 0.02, "replacement_chars")
        .when(F.length(text) == 0, "empty")
        .when(F.length(text) < min_chars, "too_short")
    )


def first_copies(df: DataFrame, key: str, order: str) -> DataFrame:
    """``df`` with first, the smallest ``order`` that has the row's key.

    Grouped before it is joined back: copies are combined ahead of the shuffle, and a key that very
    many rows share meets a join that can be split, not a window in one task.
    """
    first = df.groupBy(key).agg(F.min(order).alias("first"))
    return df.join(first, key)


def decided(df: DataFrame, order: str, text: str, min_chars: int = 200) -> DataFrame:
    """``df`` less its text, with chars and reason: why a document goes, 'exact_duplicate' for later copies, or 'kept'.

    Texts are judged in one pass; what follows works on narrow rows that are written once.
    """
    headed = tx.computed(df, "siltstone_head", tx.leading_words(F.col(text)))
    judged = tx.computed(headed, "siltstone_early", reason(F.col(text), min_chars, F.col("siltstone_head"))).drop("siltstone_head")
    judged = judged.withColumns({"content_key": content_key(F.col(text)), "chars": F.length(text).cast("long")})
    judged = staged(judged.drop(text), "judged")
    left = judged.filter("siltstone_early is null")
    first = left.groupBy("content_key").agg(F.min(order).alias("siltstone_first"))
    joined = judged.join(first, "content_key", "left")
    late = F.when(F.col(order) != F.col("siltstone_first"), "exact_duplicate").otherwise("kept")
    return joined.withColumn("reason", F.coalesce("siltstone_early", late)).drop("siltstone_early", "siltstone_first")


def lines(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, pos, line): the stripped lines of each text, blank ones too."""
    return df.select(*keys, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("line", tx.strip(F.col("line")))


def with_next_line(numbered: DataFrame, key: str) -> DataFrame:
    """``numbered`` with next_line, the next line of the document that isn't blank ('' if there is none).

    From the last line back: a frame that only grows is carried on from row to row, one that shrinks is gone through again for each.
    """
    ahead = Window.partitionBy(key).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    full = F.when(F.col("line") != "", F.col("line"))
    return numbered.withColumn("next_line", F.coalesce(F.last(full, ignorenulls=True).over(ahead), F.lit("")))


def passes_score(score: Column, least: float) -> Column:
    """A missing score fails every threshold."""
    return F.coalesce(score.cast("double"), F.lit(-1e30)) >= least


def glob(pattern: str, slash: bool = True) -> str:
    """The regular expression of a file-name pattern; * and ? stop at slashes unless they may pass."""
    any_ = "." if slash else "[^/]"
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += f"{any_}*"
        elif c == "?":
            out += any_
        elif end > 0:
            out, i = out + pattern[i : end + 1].replace("[!", "[^"), end
        else:
            out += re.escape(c)
        i += 1
    return out


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a path or its file name fits one of the patterns, whatever its case."""
    name = F.substring_index(path, "/", -1)
    out = F.lit(False)
    for p in patterns:
        rule = f"(?i)^{glob(p)}$"
        out = out | path.rlike(rule) | name.rlike(rule)
    return out


def first_n(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The first n rows of each value of ``by``."""
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumn("siltstone_rn", F.row_number().over(w)).filter(F.col("siltstone_rn") <= n).drop("siltstone_rn")
