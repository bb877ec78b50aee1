"""Keyword dictionaries matched against word tables.

A term is one word or several. ``=TERM`` is matched as it is written, others in lower case; a star
at the end makes the last word a prefix, one at the start makes a single word a suffix. Between the
words of a phrase any separators may stand. Overlapping terms all count.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx


#: Terms up to which the dictionary is sent to the words; a longer one is joined by shuffles.
SENT_TERMS = 200_000


@dataclass(frozen=True)
class Term:
    term: str
    kind: str  # word, exact, prefix, suffix or phrase
    words: tuple[str, ...]
    open_end: bool = False

    @staticmethod
    def parse(term: str) -> "Term":
        body = term.strip()
        exact = body.startswith("=")
        body = body.removeprefix("=")
        start, end = body.startswith("*"), body.endswith("*")
        found = re.findall(r"\w+", body.strip("*"))
        if not found:
            raise ValueError(f"no word in the term {term!r}")
        parts = tuple(found if exact else [w.lower() for w in found])
        if len(parts) > 1:
            if start or exact:
                raise ValueError(f"{term!r}: a phrase takes a star at its end only")
            return Term(term, "phrase", parts, end)
        if exact and (start or end):
            return Term(term, "exact_prefix" if end else "exact_suffix", parts)
        return Term(term, "exact" if exact else "prefix" if end else "suffix" if start else "word", parts)


SCHEMA = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("parts", T.ArrayType(T.StringType())),
        T.StructField("open_end", T.BooleanType()),
    ]
)


def dictionary(spark: SparkSession, terms: list[str]) -> DataFrame:
    """The parsed terms, distinct in their order."""
    parsed = [Term.parse(t) for t in dict.fromkeys(terms)]
    return spark.createDataFrame([(t.term, t.kind, list(t.words), t.open_end) for t in parsed], SCHEMA)


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """Terms of a list file: commas or lines between them, # starts a comment, each term once, at the first place."""
    line = F.regexp_replace(F.regexp_replace("value", "^\\x{FEFF}", ""), "#.*", "")
    # a list is one text: the lines keep their places
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r\n?|\n")).alias("at", "value"))
    rows = whole.select("at", F.posexplode(F.split(line, ",")).alias("k", "term"))
    rows = rows.withColumn("term", tx.squashed(F.col("term"))).filter("term <> ''")
    bad = rows.filter(F.length("term") > 100).limit(1).collect()
    if bad:
        raise ValueError(f"a term has more than 100 characters: {bad[0]['term'][:40]}...")
    return rows.groupBy("term").agg(F.min(F.struct("at", "k")).alias("first")).orderBy("first").select("term")


#: Different pieces up to which words are tested before they become rows.
TESTED_PIECES = 50_000


def _pieces(terms: list[str]) -> list[tuple[str, int, list[str]]]:
    """(kind, length, values): what the first words of terms are, by kind and, for starts and ends of words, by length."""
    parsed = [Term.parse(t) for t in dict.fromkeys(terms)]
    found: dict[tuple[str, int], set[str]] = {}
    for t in parsed:
        part = t.kind.endswith(("prefix", "suffix"))
        found.setdefault((t.kind, len(t.words[0]) if part else 0), set()).add(t.words[0])
    return [(kind, n, sorted(values)) for (kind, n), values in sorted(found.items())]


def _cut(word: Column, kind: str, n: int) -> Column:
    """The piece of a word under which a dictionary of this kind has it, or null."""
    word = word if kind.startswith("exact") else F.lower(word)
    if kind.endswith("prefix"):
        return F.when(F.length(word) >= n, F.substring(word, 1, n))
    if kind.endswith("suffix"):
        return F.when(F.length(word) >= n, F.right(word, F.lit(n)))
    return word


def word_table(df: DataFrame, id_col: str, text: Column, chars: int | None = None, ahead: int | None = None, terms: list[str] | None = None, weighted: list[tuple[Column, int]] | None = None) -> DataFrame:
    """(id, word, next, weight): words with the words that follow them, as many as the longest of ``terms`` has (or ``ahead``).

    With ``terms`` only words that one of them may begin with, which is tested before they become rows. Texts
    are read whole; ``chars`` limits them to the first so many characters. ``weighted`` has further
    texts of a row and what their words weigh; those of ``text`` weigh 1. Null texts have no words.
    """
    if ahead is None:
        ahead = max([len(Term.parse(t).words) - 1 for t in terms], default=0) if terms is not None else 8
    texts = [(text if chars is None else F.substring(text, 1, chars), 1), *(weighted or [])]
    # a text's words are made once; the rows that follow live within one generated loop, until the test has dropped most
    each = [F.struct(tx.words(F.coalesce(t, F.lit(""))).alias("w"), F.lit(weight).alias("weight")) for t, weight in texts]
    own = df.select(F.col(id_col).alias("id"), F.explode(F.array(*each)).alias("t")).select("id", "t.weight", F.col("t.w").alias("w"))
    rows = own.select("id", "weight", "w", F.posexplode("w").alias("pos", "word"))
    pieces = _pieces(terms) if terms is not None else []
    if terms is not None and sum(len(v) for _, _, v in pieces) <= TESTED_PIECES:
        test = F.lit(False)
        for kind, n, values in pieces:
            test = test | F.coalesce(_cut(F.col("word"), kind, n).isin(*values), F.lit(False))
        rows = rows.filter(test)
    return rows.select("id", "word", F.slice("w", F.col("pos") + 2, F.lit(ahead)).alias("next"), "weight")


def hits(words: DataFrame, terms: list[str], by_weight: bool = False) -> DataFrame:
    """(id, term, hits) of the word table, or by weight too.

    Each word gives the few pieces under which the dictionary may have it (itself, as many leading
    or closing characters as some term has), so that one pass over the words and one equi-join with
    the dictionary serve all kinds of terms.
    """
    parsed = [Term.parse(t) for t in dict.fromkeys(terms)]
    table = dictionary(words.sparkSession, terms)
    pieces = [F.struct(F.lit(kind).alias("kind"), _cut(F.col("word"), kind, n).alias("piece")) for kind, n, _ in _pieces(terms)]
    rows = words.select("id", "next", "weight", F.explode(F.array(*pieces)).alias("p")).select("id", "next", "weight", F.col("p.kind").alias("kind"), F.col("p.piece").alias("piece"))
    if len(parsed) <= SENT_TERMS:  # the list came from the driver: this is what bounds what is sent
        table = F.broadcast(table)
    table = table.withColumn("piece", F.col("parts")[0]).withColumn("rest", F.slice("parts", 2, 1_000_000))
    found = rows.filter("piece is not null").join(table, ["kind", "piece"])
    after, n = F.transform("next", F.lower), F.size("rest")
    whole = F.slice(after, F.lit(1), n) == F.col("rest")
    opened = (F.size("next") >= n) & (F.slice(after, F.lit(1), n - 1) == F.slice("rest", F.lit(1), n - 1)) & F.startswith(F.get(after, n - 1), F.element_at("rest", -1))
    phrase = F.when(n == 0, True).when(F.col("open_end"), F.coalesce(opened, F.lit(False))).otherwise(whole)
    return found.filter(phrase).groupBy("id", "term", *(["weight"] if by_weight else [])).agg(F.count("*").alias("hits"))


def found(df: DataFrame, id_col: str, text: Column, terms: list[str]) -> DataFrame:
    """(id, term, hits) of whole texts."""
    return hits(word_table(df, id_col, text, terms=terms), terms)


#: Where terms are looked for (F05): texts that are no Markdown, all, or nowhere.
SCOPES = ("web", "all", "none")


def keyword_filter(
    df: DataFrame, terms: list[str], exclude: list[str], id_col: str, text_col: str, title_col: str | None = None, min_hits: int = 3, min_distinct: int = 2, in_scope: Column | None = None
) -> DataFrame:
    """(id, score, n_terms, reason) of every document: hits in the title weigh three times, and a reason says why a document goes.

    Terms and excluded terms are looked for in title and text, in one pass. Rows out of scope are
    not judged: score 0, no reason. Null texts have no hits; rows of one id are one document.
    """
    scoped = df if in_scope is None else df.filter(in_scope)
    both = list(dict.fromkeys([*terms, *exclude]))
    weighted = [] if title_col is None else [(F.col(title_col), 3)]
    by = hits(word_table(scoped, id_col, F.col(text_col), terms=both, weighted=weighted), both, by_weight=True)
    wanted, unwanted = F.col("term").isin(*terms) if terms else F.lit(False), F.col("term").isin(*exclude) if exclude else F.lit(False)
    score = by.groupBy("id").agg(
        F.sum(F.when(wanted, F.col("hits") * F.col("weight")).otherwise(0)).alias("score"),
        F.count_distinct(F.when(wanted, F.col("term"))).alias("n_terms"),
        F.max(unwanted).alias("bad"),
    )
    judged = F.lit(True) if in_scope is None else F.coalesce(in_scope, F.lit(False))
    out = df.select(F.col(id_col).alias("id"), judged.alias("judged")).join(score, "id", "left").na.fill(0, ["score", "n_terms"])
    reason = (
        F.when(~F.col("judged"), "")
        .when(F.col("bad"), "keyword_excluded")
        .when(F.col("score") < min_hits, "keyword_min_hits")
        .when(F.col("n_terms") < min_distinct, "keyword_min_distinct")
        .otherwise("")
    )
    return out.select(F.col("id").alias(id_col), "score", "n_terms", reason.alias("reason"))


def covered(table: DataFrame) -> DataFrame:
    """(term, covered_by): terms that another covers word by word: as the same word, by a prefix or by a suffix."""
    t = table.withColumn("n", F.size("parts")).withColumn("block", F.substring(F.col("parts")[0], 1, 3))
    a = t.select(F.col("term").alias("term"), F.col("parts").alias("a"), F.col("kind").alias("a_kind"), "n", "block", F.col("open_end").alias("a_open"))
    b = t.select(F.col("term").alias("covered_by"), F.col("parts").alias("b"), F.col("kind").alias("b_kind"), "n", "block", F.col("open_end").alias("b_open"))
    n = F.col("n")
    same = F.slice("a", 1, n - 1) == F.slice("b", 1, n - 1)
    last_a, last_b = F.element_at("a", -1), F.element_at("b", -1)
    wide = F.col("b_open") | (F.col("b_kind") == "prefix")
    narrow = ~(F.col("a_open") | (F.col("a_kind") == "prefix"))
    fits = F.when(wide, F.startswith(last_a, last_b)).otherwise((last_a == last_b) & narrow)
    plain = F.col("a_kind").isin("word", "prefix", "phrase") & F.col("b_kind").isin("word", "prefix", "phrase")
    return a.join(b, ["n", "block"]).filter((F.col("term") != F.col("covered_by")) & plain & same & fits).select("term", "covered_by").distinct()
