"""Queries on keyword dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import keywords
from .catalog import register
from .common import docs

SINGLE = ["that", "for", "la", "der", "=The", "=La"]
AFFIX = ["thtion*", "ver*", "*tion", "*mente", "re*", "=Th*"]
PHRASE = ["of the", "is the re*", "la de", "in th*", "and, of"]
ALL = SINGLE + AFFIX + PHRASE

_W = f"""
w AS (SELECT doc_id, word, lower(word) AS low, pos, ws FROM (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos, ws FROM (SELECT doc_id, regexp_extract_all(text, '{tx.WORD}') AS ws FROM documents)))
"""


def _condition(term: str) -> str:
    t = keywords.Term.parse(term)
    column = "word" if t.kind.startswith("exact") else "low"
    first = t.words[0]
    kind = t.kind.removeprefix("exact_")
    if kind in ("word", "exact"):
        return f"{column} = '{first}'"
    if kind == "prefix":
        return f"starts_with({column}, '{first}')"
    if kind == "suffix":
        return f"ends_with({column}, '{first}')"
    tests = [f"low = '{first}'"]
    for k, word in enumerate(t.words[1:], 1):
        following = f"lower(ws[pos + {k}])"
        last = k == len(t.words) - 1
        tests.append(f"starts_with({following}, '{word}')" if last and t.open_end else f"{following} = '{word}'")
    return "coalesce(" + " AND ".join(tests) + ", false)"


def _hits(terms: list[str]) -> str:
    each = " UNION ALL ".join(f"SELECT doc_id, '{t}' AS term FROM w WHERE {_condition(t)}" for t in terms)
    return f"h AS (SELECT doc_id, term, count(*)::BIGINT AS hits FROM ({each}) GROUP BY doc_id, term)"


def _hit_query(name: str, terms: list[str]) -> None:
    @register(name, f"WITH {_W}, {_hits(terms)} SELECT * FROM h")
    def run(spark, sf_dir):
        return keywords.found(docs(spark, sf_dir), "doc_id", F.col("text"), terms).withColumnRenamed("id", "doc_id")


_hit_query("j01_single_terms", SINGLE)
_hit_query("j02_affixes", AFFIX)
_hit_query("j03_phrases", PHRASE)

_FILTER_TERMS = ["that", "la", "*tion", "of the", "der"]
_TITLED = (
    f"t AS (SELECT doc_id, ws, unnest(ws) AS word, lower(unnest(ws)) AS low, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(substr(text, 1, 60), '{tx.WORD}') AS ws FROM documents))"
)


@register(
    "f04_keyword_filter",
    f"""
    WITH {_W}, {_TITLED}, {_hits(_FILTER_TERMS)},
    ht AS (SELECT doc_id, term, count(*) AS hits FROM ({' UNION ALL '.join(f"SELECT doc_id, '{t}' AS term FROM t WHERE {_condition(t)}" for t in _FILTER_TERMS)}) GROUP BY doc_id, term),
    s AS (SELECT doc_id, sum(hits * weight)::BIGINT AS score, count(DISTINCT term)::BIGINT AS n_terms FROM (SELECT *, 1 AS weight FROM h UNION ALL SELECT *, 3 AS weight FROM ht) GROUP BY doc_id),
    x AS (SELECT doc_id FROM w WHERE starts_with(low, 'gmbh') OR low = 'von' UNION SELECT doc_id FROM t WHERE starts_with(low, 'gmbh') OR low = 'von')
    SELECT d.doc_id, coalesce(s.score, 0)::BIGINT AS score, coalesce(s.n_terms, 0)::BIGINT AS n_terms,
      CASE WHEN x.doc_id IS NOT NULL THEN 'keyword_excluded' WHEN coalesce(s.score, 0) < 3 THEN 'keyword_min_hits' WHEN coalesce(s.n_terms, 0) < 2 THEN 'keyword_min_distinct' ELSE '' END AS reason
    FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN x USING (doc_id)
    """,
)
def f04(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("title", F.substring("text", 1, 60))
    return keywords.keyword_filter(d, _FILTER_TERMS, ["gmbh*", "von"], "doc_id", "text", "title")


@register("a02_keyword_totals", f"WITH {_W}, {_hits(ALL)} SELECT source, term, sum(hits)::BIGINT AS hits FROM h JOIN documents USING (doc_id) GROUP BY source, term")
def a02(spark, sf_dir):
    d = docs(spark, sf_dir)
    found = keywords.found(d, "doc_id", F.col("text"), ALL).withColumnRenamed("id", "doc_id")
    return found.join(d.select("doc_id", "source"), "doc_id").groupBy("source", "term").agg(F.sum("hits").alias("hits"))


@register(
    "a31_term_document_frequency",
    f"WITH {_W}, {_hits(ALL)} SELECT term, count(DISTINCT doc_id)::BIGINT AS documents, round(count(DISTINCT doc_id) / (SELECT count(*) FROM documents), 6) AS share,"
    " count(DISTINCT doc_id) > 0.01 * (SELECT count(*) FROM documents) AS common FROM h GROUP BY term",
)
def a31(spark, sf_dir):
    d = docs(spark, sf_dir)
    found = keywords.found(d, "doc_id", F.col("text"), ALL)
    n = d.agg(F.count("*").alias("all"))
    by = found.groupBy("term").agg(F.count_distinct("id").alias("documents"))
    return by.join(F.broadcast(n)).select("term", "documents", F.round(F.col("documents") / F.col("all"), 6).alias("share"), (F.col("documents") > 0.01 * F.col("all")).alias("common"))


_TOP = f"SELECT doc_id, source, round(hits / sqrt(greatest(length(text), 500)), 6) AS score FROM (SELECT doc_id, sum(hits) AS hits FROM h GROUP BY doc_id) JOIN documents USING (doc_id) WHERE length(text) >= 200"


@register(
    "t01_top_density",
    f"WITH {_W}, {_hits(ALL)}, s AS ({_TOP}), c AS (SELECT * FROM s ORDER BY score DESC, doc_id LIMIT 130) SELECT doc_id, source, score, row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS rank FROM c QUALIFY rank <= 20",
)
def t01(spark, sf_dir):
    """Two phases: a slack of half as much again and a hundred, then the exact cut."""
    d = docs(spark, sf_dir)
    found = keywords.found(d, "doc_id", F.col("text"), ALL).groupBy("id").agg(F.sum("hits").alias("hits"))
    scored = found.join(d, F.col("id") == F.col("doc_id")).filter(F.length("text") >= 200)
    scored = scored.select("doc_id", "source", F.round(F.col("hits") / F.sqrt(F.greatest(F.length("text"), F.lit(500))), 6).alias("score"))
    slack = scored.orderBy(F.desc("score"), "doc_id").limit(int(1.5 * 20) + 100)
    w = Window.orderBy(F.desc("score"), "doc_id")  # over the bounded slack
    return slack.select("*", F.row_number().over(w).alias("rank")).filter("rank <= 20")


@register(
    "t02_rank_density",
    f"WITH {_W}, {_hits(ALL)}, n AS (SELECT doc_id, count(*) AS words FROM w GROUP BY doc_id), s AS (SELECT doc_id, source, round(sum(hits) / sqrt(greatest(any_value(words), 50)), 6) AS density, any_value(n_chars) AS chars FROM h JOIN n USING (doc_id) JOIN documents USING (doc_id) GROUP BY doc_id, source)"
    " SELECT doc_id, density, row_number() OVER (PARTITION BY source ORDER BY density DESC, chars DESC, doc_id)::INTEGER AS rank FROM s",
)
def t02(spark, sf_dir):
    d = docs(spark, sf_dir)
    found = keywords.found(d, "doc_id", F.col("text"), ALL).groupBy("id").agg(F.sum("hits").alias("hits"))
    s = found.join(d.select(F.col("doc_id").alias("id"), "source", "n_chars", F.regexp_count("text", F.lit(tx.WORD)).alias("words")), "id")
    s = s.withColumn("density", F.round(F.col("hits") / F.sqrt(F.greatest("words", F.lit(50))), 6))
    w = Window.partitionBy("source").orderBy(F.desc("density"), F.desc("n_chars"), "id")
    return s.select(F.col("id").alias("doc_id"), "density", F.row_number().over(w).alias("rank"))


_COVER = ["gene", "gene*", "genetic", "genome*", "gene pool", "gene po*", "protein", "protein fold*", "protein folding", "rna", "allele*", "alleles"]


@register(
    "j20_covered_terms",
    "SELECT * FROM (VALUES ('gene', 'gene*'), ('genetic', 'gene*'), ('gene pool', 'gene po*'), ('protein folding', 'protein fold*'), ('alleles', 'allele*')) AS t(term, covered_by)",
)
def j20(spark, sf_dir):
    return keywords.covered(keywords.dictionary(spark, _COVER))
