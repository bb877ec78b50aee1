"""Queries on near-duplicates and repeated lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import dedup
from .catalog import register
from .common import KEY, SQUASH, SQUEEZE, docs, md5, table
from .text_queries import _LINES_SQL

_MARKED = _LINES_SQL + f""", keyed AS (SELECT doc_id, source, pos, line, md5({SQUASH('lower(line)')}) AS key, length(line) >= 20 AND candidate AS candidate FROM marked),
freq AS (SELECT source, key, count(DISTINCT doc_id)::BIGINT AS documents FROM keyed WHERE candidate GROUP BY source, key HAVING count(DISTINCT doc_id) >= 4)"""


@register("a03_line_frequency", f"WITH {_MARKED} SELECT * FROM freq")
def a03(spark, sf_dir):
    return dedup.boilerplate(dedup.candidate_lines(docs(spark, sf_dir), "doc_id", "source"), 4)


@register(
    "j04_strip_boilerplate",
    f"""
    WITH {_MARKED}, g AS (SELECT k.*, k.candidate AND f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN freq f USING (source, key))
    SELECT doc_id, md5({SQUEEZE("coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')")}) AS digest,
           count(*) FILTER (WHERE gone)::BIGINT AS n_removed FROM g GROUP BY doc_id
    """,
)
def j04(spark, sf_dir):
    out = dedup.strip_boilerplate(docs(spark, sf_dir), "doc_id", "source", 4)
    return out.select(F.col("id").alias("doc_id"), md5(F.col("text")).alias("digest"), "n_removed")


@register(
    "a06_removed_lines",
    f"WITH {_MARKED} SELECT source, key, any_value(documents) AS documents, count(*)::BIGINT AS removed, md5(arg_min(substr(line, 1, 200), doc_id * 1000000 + pos)) AS example FROM keyed JOIN freq USING (source, key) WHERE candidate GROUP BY source, key",
)
def a06(spark, sf_dir):
    return dedup.removed_lines(docs(spark, sf_dir), "doc_id", "source", 4).withColumn("example", md5(F.col("example")))


_SHINGLES = f"""
wd AS (SELECT doc_id, text, regexp_extract_all(lower(text), '{tx.SHINGLE_WORD}') AS ws FROM documents),
runs AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [{KEY('text')}] ELSE list_distinct(list_transform(range(0, greatest(len(ws) - 5, 0) + 1), lambda i: array_to_string(ws[i + 1:i + 5], ' '))) END) AS run FROM wd),
hs AS (SELECT doc_id, ('0x' || substr(md5(run), 1, 13))::BIGINT AS h FROM runs)"""
_SIGNED = _SHINGLES + """,
low AS (SELECT doc_id, (h >> 45)::INTEGER AS bucket, min(h & 4294967295) AS low FROM hs GROUP BY ALL),
held AS (SELECT doc_id, list_sort(list({'bucket': bucket, 'low': low})) AS f FROM low GROUP BY doc_id),
sig AS (SELECT doc_id, list_transform(range(0, 128), lambda b: ((coalesce(list_filter(f, lambda x: x.bucket >= b)[1], f[1])).low
  + (((coalesce(list_filter(f, lambda x: x.bucket >= b)[1], f[1])).bucket - b + 128) % 128) * 2654435761) & 4294967295) AS s FROM held)"""
_PAIRS = _SIGNED + """,
bands AS (SELECT doc_id, band, md5(array_to_string(s[band * 8 + 1:band * 8 + 8], ',')) AS key FROM sig, (SELECT unnest(range(0, 16)) AS band)),
win AS (SELECT doc_id, first_value(doc_id) OVER w AS first, lag(doc_id) OVER w AS prev FROM bands WINDOW w AS (PARTITION BY band, key ORDER BY doc_id)),
cand AS (SELECT first AS src, doc_id AS dst FROM win WHERE first <> doc_id UNION SELECT prev, doc_id FROM win WHERE prev IS NOT NULL AND prev <> doc_id),
pairs AS (SELECT src, dst, len(list_filter(list_zip(a.s, b.s), lambda z: z[1] = z[2])) / 128.0::DOUBLE AS similarity FROM cand JOIN sig a ON a.doc_id = src JOIN sig b ON b.doc_id = dst),
good AS (SELECT * FROM pairs WHERE similarity >= 0.8)"""
_CLUSTERS = _PAIRS + """,
sym AS (SELECT src, dst FROM good UNION SELECT dst, src FROM good),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT b.dst, r.root FROM reach r JOIN sym b ON b.src = r.node),
roots AS (SELECT node AS doc_id, min(root) AS root FROM reach GROUP BY node)"""


@register("d03_shingles", f"WITH {_SHINGLES} SELECT doc_id, count(*)::BIGINT AS n, min(h) AS lowest, max(h) AS highest FROM hs GROUP BY doc_id")
def d03(spark, sf_dir):
    h = dedup.shingle_hashes(docs(spark, sf_dir), "doc_id", "text")
    return h.select(F.col("id").alias("doc_id"), F.size("hashes").cast("long").alias("n"), F.array_min("hashes").alias("lowest"), F.array_max("hashes").alias("highest"))


@register("d04_minhash", f"WITH {_SIGNED} SELECT doc_id, md5(array_to_string(s, ',')) AS digest FROM sig")
def d04(spark, sf_dir):
    s = dedup.signatures(docs(spark, sf_dir), "doc_id", "text")
    joined = F.array_join(F.transform("signature", lambda v: v.cast("string")), ",")
    return s.select(F.col("id").alias("doc_id"), md5(joined).alias("digest"))


@register("j06_lsh_pairs", f"WITH {_PAIRS} SELECT src, dst, similarity FROM good")
def j06(spark, sf_dir):
    return dedup.band_pairs(dedup.staged(dedup.signatures(docs(spark, sf_dir), "doc_id", "text"), "signatures"))


@register("d07_clusters", f"WITH RECURSIVE {_CLUSTERS} SELECT * FROM roots")
def d07(spark, sf_dir):
    signed = dedup.staged(dedup.signatures(docs(spark, sf_dir), "doc_id", "text"), "signatures")
    return dedup.clusters(signed).withColumnRenamed("id", "doc_id")


@register(
    "d09_near_duplicates",
    f"WITH RECURSIVE {_CLUSTERS} SELECT r.doc_id, r.root, len(list_filter(list_zip(a.s, b.s), lambda z: z[1] = z[2])) / 128.0::DOUBLE AS similarity FROM roots r JOIN sig a ON a.doc_id = r.doc_id JOIN sig b ON b.doc_id = r.root WHERE r.doc_id <> r.root",
)
def d09(spark, sf_dir):
    return dedup.near_duplicates(docs(spark, sf_dir), "doc_id", "text").withColumnRenamed("id", "doc_id")


@register(
    "a07_cross_source",
    f"WITH RECURSIVE {_CLUSTERS} SELECT root, count(*)::BIGINT AS size, count(DISTINCT source)::BIGINT AS sources, count(DISTINCT source) > 1 AS cross_source, sum(n_chars)::BIGINT AS chars FROM roots JOIN documents USING (doc_id) GROUP BY root HAVING count(*) > 1",
)
def a07(spark, sf_dir):
    d = docs(spark, sf_dir)
    signed = dedup.staged(dedup.signatures(d, "doc_id", "text"), "signatures")
    joined = dedup.clusters(signed).join(d, F.col("id") == F.col("doc_id"))
    by = joined.groupBy("root").agg(F.count("*").alias("size"), F.count_distinct("source").alias("sources"), F.sum("n_chars").alias("chars")).filter("size > 1")
    return by.select("root", "size", "sources", (F.col("sources") > 1).alias("cross_source"), "chars")


@register(
    "d11_row_output_dedup",
    f"SELECT label, min(doc_id) AS doc_id FROM (SELECT lang AS label, doc_id, sha1({SQUASH('text')}) AS h, length(regexp_replace(text, '{tx.SPACE}', '', 'g')) AS visible FROM documents) WHERE visible >= 200 GROUP BY label, h",
)
def d11(spark, sf_dir):
    visible = F.length(F.regexp_replace("text", tx.SPACE, ""))
    d = docs(spark, sf_dir).filter(visible >= 200).select(F.col("lang").alias("label"), "doc_id", F.sha1(tx.squashed(F.col("text")).cast("binary")).alias("h"))
    return d.groupBy("label", "h").agg(F.min("doc_id").alias("doc_id")).select("label", "doc_id")


@register("d13_seen_urls", "SELECT min(page_id) AS page_id, lower(split_part(split_part(url, '?', 1), '#', 1)) AS url FROM pages GROUP BY 2")
def d13(spark, sf_dir):
    url = F.lower(F.substring_index(F.substring_index("url", "?", 1), "#", 1))
    return table(spark, sf_dir, "pages").select("page_id", url.alias("url")).groupBy("url").agg(F.min("page_id").alias("page_id"))
