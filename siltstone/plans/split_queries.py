"""Queries on the split, leakage, the ledger and token tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import hashing, planner, text as tx
from ..operators import split, tokens
from ..session import staged
from .catalog import register
from .common import KEY, docs, table

_U = "('0x' || substr(md5('58' || chr(31) || 'split' || chr(31) || root_source || ':' || root), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
_BASE = f"""
keyed AS (SELECT doc_id, source, n_chars AS chars, {KEY('text')} AS key FROM documents),
firsts AS (SELECT key, min(doc_id) AS root FROM keyed GROUP BY key),
d AS (SELECT k.doc_id, k.source, k.chars, k.key, f.root, o.source AS root_source FROM keyed k JOIN firsts f USING (key) JOIN keyed o ON o.doc_id = f.root)"""


def _groups(fixed: str = "SELECT NULL::BIGINT AS root, NULL::VARCHAR AS fixed WHERE false") -> str:
    return f"""{_BASE}, fx AS ({fixed}),
cr AS (SELECT root, count(DISTINCT source) > 1 AS crosses FROM d GROUP BY root),
g0 AS (SELECT source, root, sum(chars)::BIGINT AS chars, min(doc_id) AS first, any_value(root_source) AS root_source FROM d GROUP BY source, root),
g AS (SELECT g0.*, cr.crosses, fx.fixed, {_U} AS u FROM g0 JOIN cr USING (root) LEFT JOIN fx USING (root)),
t AS (SELECT source, least(sum(chars) * 0.05::DOUBLE, 20000000) AS budget, count(*) AS n, coalesce(sum(chars) FILTER (WHERE fixed = 'val'), 0)::DOUBLE AS start FROM g GROUP BY source),
o AS (SELECT g.source, g.root, g.chars, t.budget, t.start, row_number() OVER (PARTITION BY g.source ORDER BY u, first, root) AS k FROM g JOIN t USING (source)
      WHERE fixed IS NULL AND NOT crosses AND g.chars <= 0.25 * t.budget AND t.n >= 2),
fold AS (
  SELECT source, 0::BIGINT AS k, start AS used, NULL::BIGINT AS root, false AS taken FROM t
  UNION ALL
  SELECT o.source, o.k, CASE WHEN f.used < o.budget AND f.used + o.chars <= o.budget * 1.1 THEN f.used + o.chars ELSE f.used END, o.root,
         f.used < o.budget AND f.used + o.chars <= o.budget * 1.1
  FROM fold f JOIN o ON o.source = f.source AND o.k = f.k + 1
),
sp AS (SELECT g.source, g.root, coalesce(g.fixed, CASE WHEN f.taken THEN 'val' ELSE 'train' END) AS split FROM g LEFT JOIN fold f ON f.source = g.source AND f.root = g.root)"""


def _rooted(spark, sf_dir):
    """(source, id, key, root, root_source, chars): clusters of equal content."""
    d = docs(spark, sf_dir).select("source", F.col("doc_id").alias("id"), hashing.content_key(F.col("text")).alias("key"), F.col("n_chars").alias("chars"))
    d = staged(d, "keyed")
    first = d.groupBy("key").agg(F.min_by(F.struct(F.col("id").alias("root"), F.col("source").alias("root_source")), "id").alias("f"))
    return d.join(first, "key").select("source", "id", "key", "chars", "f.root", "f.root_source")


@register("sp01_group_split", f"WITH RECURSIVE {_groups()} SELECT source, root, split FROM sp")
def sp01(spark, sf_dir):
    return split.group_split(_rooted(spark, sf_dir))


_EARLIER = "SELECT source, doc_id, key, CASE WHEN doc_id % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM keyed WHERE doc_id % 3 = 0"
_FIXED = f"""SELECT root, CASE WHEN bool_or(split = 'train') THEN 'train' ELSE 'val' END AS fixed FROM (
  SELECT d.root, e.split FROM d JOIN ({_EARLIER}) e ON e.source = d.source AND e.doc_id = d.doc_id UNION ALL SELECT d.root, e.split FROM d JOIN ({_EARLIER}) e ON e.key = d.key) GROUP BY root"""


def _earlier(rooted):
    when = F.when(F.col("id") % 5 == 0, "val").otherwise("train")
    return rooted.filter("id % 3 = 0").select("source", F.col("id").cast("string").alias("id"), "key", when.alias("split"))


@register("j07_previous_split", f"WITH {_BASE} SELECT root, fixed AS split FROM ({_FIXED})")
def j07(spark, sf_dir):
    rooted = _rooted(spark, sf_dir).withColumn("id", F.col("id").cast("string"))
    return split.previous_split(rooted, _earlier(_rooted(spark, sf_dir)))


@register("sp02_keep_split", f"WITH RECURSIVE {_groups(_FIXED)} SELECT source, root, split FROM sp")
def sp02(spark, sf_dir):
    rooted = _rooted(spark, sf_dir)
    settled = split.previous_split(rooted.withColumn("id", F.col("id").cast("string")), _earlier(rooted))
    return split.group_split(rooted, settled=settled)


def _grams(source: str, key: str, n: int, keep: int) -> str:
    return f"""SELECT DISTINCT {key} AS id, h FROM (SELECT {key}, ('0x' || substr(md5(run), 1, 13))::BIGINT AS h FROM (
  SELECT {key}, unnest(list_transform(range(0, len(ws) - {n - 1}), lambda i: array_to_string(ws[i + 1:i + {n}], ' '))) AS run FROM (
    SELECT {key}, regexp_extract_all(lower(text), '{tx.SHINGLE_WORD}') AS ws FROM {source}) WHERE len(ws) >= {n})) WHERE h % {keep} = 0"""


@register(
    "j08_ngram_overlap",
    f"WITH b AS ({_grams('benchmark', 'item_id', 13, 1)}), t AS (SELECT DISTINCT h FROM ({_grams('documents', 'doc_id', 13, 1)}))"
    " SELECT id AS item_id, count(*)::BIGINT AS sampled, count(t.h)::BIGINT AS matched, round(count(t.h) / count(*), 6) AS overlap FROM b LEFT JOIN t USING (h) GROUP BY id HAVING count(*) >= 5",
)
def j08(spark, sf_dir):
    held = split.ngram_hashes(table(spark, sf_dir, "benchmark"), "item_id", "text", 13, 1)
    found = split.overlap(held, split.ngram_hashes(docs(spark, sf_dir), "doc_id", "text", 13, 1))
    return found.select(F.col("id").alias("item_id"), "sampled", "matched", F.round("overlap", 6).alias("overlap"))


_VAL = "(SELECT * FROM documents WHERE doc_id % 4 = 0)"
_TRAIN = "(SELECT * FROM documents WHERE doc_id % 4 <> 0)"
_LEAK = f"""v AS ({_grams(_VAL, 'doc_id', 13, 16)}), t AS (SELECT DISTINCT h FROM ({_grams(_TRAIN, 'doc_id', 13, 16)})),
leak AS (SELECT id, count(*)::BIGINT AS sampled, count(t.h)::BIGINT AS matched, count(t.h)::DOUBLE / count(*) AS overlap FROM v LEFT JOIN t USING (h) GROUP BY id HAVING count(*) >= 5)"""


def _leaks(spark, sf_dir):
    d = docs(spark, sf_dir)
    return split.overlap(split.ngram_hashes(d.filter("doc_id % 4 = 0"), "doc_id", "text"), split.ngram_hashes(d.filter("doc_id % 4 <> 0"), "doc_id", "text"))


@register("sp03_leakage", f"WITH {_LEAK} SELECT id AS doc_id, sampled, matched, round(overlap, 6) AS overlap FROM leak")
def sp03(spark, sf_dir):
    return _leaks(spark, sf_dir).select(F.col("id").alias("doc_id"), "sampled", "matched", F.round("overlap", 6).alias("overlap"))


@register("a14_median_overlap", f"WITH {_LEAK} SELECT count(*)::BIGINT AS documents, round(median(overlap), 6) AS median_overlap, count(*) FILTER (WHERE overlap >= 0.5)::BIGINT AS leaking FROM leak")
def a14(spark, sf_dir):
    return _leaks(spark, sf_dir).agg(F.count("*").alias("documents"), F.round(F.median("overlap"), 6).alias("median_overlap"), F.count_if(F.col("overlap") >= 0.5).alias("leaking"))


@register(
    "sp04_move",
    f"""WITH {_BASE}, {_LEAK}, s AS (SELECT DISTINCT root FROM d WHERE doc_id % 9 = 0),
    r AS (SELECT DISTINCT root FROM d JOIN leak ON leak.id = d.doc_id WHERE overlap >= 0.5 AND root NOT IN (SELECT root FROM s))
    SELECT doc_id, CASE WHEN doc_id % 4 = 0 AND r.root IS NULL THEN 'val' ELSE 'train' END AS split, doc_id % 4 = 0 AND r.root IS NOT NULL AS moved FROM d LEFT JOIN r USING (root)""",
)
def sp04(spark, sf_dir):
    rooted = _rooted(spark, sf_dir)
    state = rooted.select("id", "root", F.when(F.col("id") % 4 == 0, "val").otherwise("train").alias("split"))
    settled = rooted.filter("id % 9 = 0").select("root").distinct()
    return split.moved_to_train(state, _leaks(spark, sf_dir), settled).select(F.col("id").alias("doc_id"), "split", "moved")


@register(
    "j09_training_overlap",
    f"WITH {_BASE}, o AS (SELECT source, doc_id, key FROM keyed WHERE doc_id % 4 <> 0) SELECT doc_id FROM d WHERE doc_id % 4 = 0 AND (key IN (SELECT key FROM o) OR (source, doc_id + 1) IN (SELECT source, doc_id FROM o))",
)
def j09(spark, sf_dir):
    d = _rooted(spark, sf_dir)
    val, other = d.filter("id % 4 = 0"), d.filter("id % 4 <> 0")
    same = val.join(other.select("key"), "key", "left_semi").select("id")
    named = val.withColumn("next", F.col("id") + 1).join(other.select("source", F.col("id").alias("next")), ["source", "next"], "left_semi").select("id")
    return same.union(named).distinct().withColumnRenamed("id", "doc_id")


@register(
    "j10_positional",
    "WITH a AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents), b AS (SELECT doc_id AS other, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE n_chars > 100) SELECT a.doc_id, b.other FROM a JOIN b USING (source, k)",
)
def j10(spark, sf_dir):
    return _positional(docs(spark, sf_dir))


def _positional(d):
    w = Window.partitionBy("source").orderBy("doc_id")
    a = d.select("doc_id", "source", F.row_number().over(w).alias("k"))
    b = d.filter("n_chars > 100").select(F.col("doc_id").alias("other"), "source", F.row_number().over(w).alias("k"))
    return a.join(b, ["source", "k"]).select("doc_id", "other")


@register("sp05_no_validation", f"WITH RECURSIVE {_groups()} SELECT d.source, count(*)::BIGINT AS documents FROM d JOIN sp ON sp.source = d.source AND sp.root = d.root GROUP BY d.source HAVING count(*) >= 2 AND count(*) FILTER (WHERE sp.split = 'val') = 0")
def sp05(spark, sf_dir):
    rooted = _rooted(spark, sf_dir)
    placed = rooted.join(split.group_split(rooted), ["source", "root"])
    return placed.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("split") == "val").alias("v")).filter("documents >= 2 and v = 0").drop("v")


@register("sp06_parity", "SELECT doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 2 = 1 AS held_out FROM documents")
def sp06(spark, sf_dir):
    return split.parity(docs(spark, sf_dir).select("doc_id", "lang"), "lang", "doc_id").select("doc_id", "held_out")


_LEDGER = f"""WITH RECURSIVE {_groups()}, l AS (
  SELECT d.doc_id, d.source, CASE WHEN d.doc_id <> d.root THEN 'skipped' ELSE sp.split END AS status, CASE WHEN d.doc_id <> d.root THEN 'exact_duplicate' ELSE '' END AS reason,
         d.chars, d.root_source || ':' || d.root AS grp, d.key FROM d JOIN sp ON sp.source = d.source AND sp.root = d.root)"""


def _ledger(spark, sf_dir):
    rooted = _rooted(spark, sf_dir)
    late = F.col("id") != F.col("root")
    placed = rooted.join(split.group_split(rooted), ["source", "root"])
    return placed.select(
        F.col("id").alias("doc_id"), "source", F.when(late, "skipped").otherwise(F.col("split")).alias("status"), F.when(late, "exact_duplicate").otherwise("").alias("reason"),
        "chars", F.concat_ws(":", "root_source", "root").alias("grp"), "key",
    )


@register("k01_ledger", f"{_LEDGER} SELECT * FROM l")
def k01(spark, sf_dir):
    return _ledger(spark, sf_dir)


@register("a09_split_rollup", f"{_LEDGER} SELECT status, source, count(*)::BIGINT AS documents, sum(chars)::BIGINT AS chars FROM l GROUP BY ROLLUP (status, source)")
def a09(spark, sf_dir):
    return _ledger(spark, sf_dir).rollup("status", "source").agg(F.count("*").alias("documents"), F.sum("chars").alias("chars"))


@register("a11_fingerprint", f"{_LEDGER} SELECT sha256(string_agg(source || '/' || status || '/' || key, ',' ORDER BY doc_id)) AS fingerprint FROM l WHERE status <> 'skipped'")
def a11(spark, sf_dir):
    return tokens.fingerprint(_ledger(spark, sf_dir).filter("status <> 'skipped'"), F.concat_ws("/", "source", "status", "key"), "doc_id")


@register("a10_length_percentiles", "SELECT lang, " + ", ".join(f"floor(quantile_cont(n_chars, {p}))::BIGINT AS p{int(p * 100)}" for p in (0.1, 0.5, 0.9, 0.99)) + " FROM documents GROUP BY lang")
def a10(spark, sf_dir):
    ps = (0.1, 0.5, 0.9, 0.99)
    by = docs(spark, sf_dir).groupBy("lang").agg(F.percentile("n_chars", F.array(*[F.lit(p) for p in ps])).alias("q"))
    return by.select("lang", *[F.floor(F.col("q")[i]).alias(f"p{int(p * 100)}") for i, p in enumerate(ps)])


@register(
    "a12_token_coverage",
    f"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '{tx.WORD}')) AS token FROM documents), c AS (SELECT token, count(*)::BIGINT AS n FROM w GROUP BY token),
    r AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) AS rank, sum(n) OVER (ORDER BY n DESC, token) AS run, sum(n) OVER () AS total FROM c)
    SELECT token, n, rank::INTEGER AS rank, round(run / total, 6) AS share FROM r WHERE rank <= 200""",
)
def a12(spark, sf_dir):
    return tokens.coverage(docs(spark, sf_dir).select(F.explode(tx.words(F.lower("text"))).alias("token")), 200)


@register(
    "a12_coverage_ranks",
    f"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '{tx.WORD}')) AS token FROM documents), c AS (SELECT token, count(*)::BIGINT AS n FROM w GROUP BY token),
    r AS (SELECT row_number() OVER (ORDER BY n DESC, token) AS rank, sum(n) OVER (ORDER BY n DESC, token) AS run, sum(n) OVER () AS total FROM c)
    SELECT p AS percent, min(rank)::BIGINT AS rank FROM r, (VALUES (50), (90), (99)) t(p) WHERE run * 100 >= total * p GROUP BY p""",
)
def a12b(spark, sf_dir):
    return tokens.coverage_ranks(docs(spark, sf_dir).select(F.explode(tx.words(F.lower("text"))).alias("token")))


@register("a13_chars_per_token", f"SELECT source, round(sum(n_chars)::DOUBLE / sum(len(regexp_extract_all(text, '{tx.WORD}'))), 3) AS chars_per_token FROM documents GROUP BY source")
def a13(spark, sf_dir):
    by = docs(spark, sf_dir).groupBy("source").agg(F.sum("n_chars").alias("c"), F.sum(F.size(tx.words(F.col("text")))).alias("t"))
    return by.select("source", F.round(F.col("c") / F.col("t"), 3).alias("chars_per_token"))


@register("tk02_vocab_rule", "SELECT source, least(65536, CASE WHEN c < 20000000 THEN 4096 ELSE 4096 * pow(2, floor(log10(c / 20000000.0)) + 1) END)::BIGINT AS vocab FROM (SELECT source, sum(n_chars) * 900 AS c FROM documents GROUP BY source)")
def tk02(spark, sf_dir):
    by = docs(spark, sf_dir).groupBy("source").agg((F.sum("n_chars") * 900).alias("c"))
    return by.select("source", planner.vocabulary_size(F.col("c")).alias("vocab"))


@register(
    "tk03_sample_shares",
    "WITH s AS (SELECT source, sum(n_chars) AS c, CASE WHEN source = 'src1' THEN 3.0 ELSE 1.0 END AS w FROM documents GROUP BY source) SELECT source, round(c * w / sum(c * w) OVER (), 6) AS share, round(least(1.0, 100000 * (c * w / sum(c * w) OVER ()) / c), 6) AS probability FROM s",
)
def tk03(spark, sf_dir):
    by = docs(spark, sf_dir).groupBy("source").agg(F.sum("n_chars").alias("chars")).withColumn("weight", F.when(F.col("source") == "src1", 3.0).otherwise(1.0))
    return tokens.sample_shares(by, 100_000).select("source", F.round("share", 6).alias("share"), F.round("probability", 6).alias("probability"))


@register(
    "t11_mix_weights",
    "WITH s AS (SELECT source, sum(n_chars) AS n, CASE WHEN source = 'src2' THEN 2.0 ELSE 1.0 END AS w FROM documents GROUP BY source) SELECT source, round(w * pow(n, 0.7) / sum(w * pow(n, 0.7)) OVER (), 6) AS p FROM s",
)
def t11(spark, sf_dir):
    by = docs(spark, sf_dir).groupBy("source").agg(F.sum("n_chars").alias("n")).withColumn("w", F.when(F.col("source") == "src2", 2.0).otherwise(1.0))
    return tokens.mix_probabilities(by, 0.7).select("source", F.round("p", 6).alias("p"))


@register("tk07_piece_category", f"""WITH p AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\\s]+')) AS piece FROM documents)
SELECT piece, CASE WHEN regexp_matches(piece, '\\p{{Nd}}') AND regexp_full_match(piece, '[\\p{{Nd}}.,+-]+') THEN 'number' WHEN regexp_full_match(piece, '\\p{{P}}+') THEN 'punctuation' WHEN regexp_full_match(piece, '[\\p{{S}}\\p{{P}}]+') THEN 'symbol/math'
  WHEN regexp_full_match(piece, '[\\p{{L}}\\p{{M}}]+') THEN CASE WHEN regexp_full_match(piece, '[\\x00-\\x{{24f}}]+') THEN 'word piece' ELSE 'non-Latin letters' END ELSE 'mixed' END AS category FROM p""")
def tk07(spark, sf_dir):
    p = docs(spark, sf_dir).select(F.explode(tx.words(F.col("text"), r"[^\s]+")).alias("piece")).distinct()
    return p.select("piece", tokens.piece_category(F.col("piece")).alias("category"))


@register("s15_documents_of_stream", """WITH t AS (SELECT doc_id, unnest([1] || list_transform(string_split(lang || source, ''), lambda c: ascii(c)) || [2]) AS token FROM documents), n AS (SELECT doc_id, count(*)::BIGINT AS n FROM t GROUP BY doc_id)
SELECT row_number() OVER (ORDER BY doc_id)::BIGINT AS document, n FROM n""")
def s15(spark, sf_dir):
    return _of_stream(docs(spark, sf_dir))


def _of_stream(d):
    ids = F.concat(F.array(F.lit(1)), F.transform(F.split(F.concat("lang", "source"), ""), lambda c: F.ascii(c)), F.array(F.lit(2)))
    stream = d.select("doc_id", F.posexplode(ids).alias("k", "token")).withColumn("pos", F.col("doc_id") * 1000 + F.col("k"))
    return tokens.documents_of(stream, "pos", "token", begin=1).groupBy("document").agg(F.count("*").alias("n"))


@register("a21_bits_per_byte", "WITH t AS (SELECT doc_id, source, n_chars * 0.7 AS nll, octet_length(encode(text)) AS bytes FROM documents) SELECT source, round(sum(nll) / (ln(2.0) * sum(bytes)), 6) AS bpb FROM t GROUP BY source")
def a21(spark, sf_dir):
    by = docs(spark, sf_dir).groupBy("source").agg(F.sum(F.col("n_chars") * 0.7).alias("nll"), F.sum(F.octet_length("text")).alias("bytes"))
    return by.select("source", F.round(F.col("nll") / (F.log(F.lit(2.0)) * F.col("bytes")), 6).alias("bpb"))


@register("planner_shapes", planner.ORACLE_SQL)
def planner_shapes(spark, sf_dir):
    return planner.shapes(spark)
