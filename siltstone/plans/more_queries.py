"""Further rows of the inventory: page furniture, robots, GWAS rows, term flags, token pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import markup
from ..operators import decisions, dedup, keywords, pages, relational, tokens, vectors
from ..sources import readers
from .catalog import register
from .common import SQUEEZE, STRIP, docs, md5, table
from .relational_queries import _sql


@register(
    "x30_page_furniture",
    """WITH l AS (SELECT doc_id % 20 AS doc, doc_id // 20 AS page, unnest(['Journal of Tests', text, 'end ' || doc_id, (doc_id // 20 + 5)::VARCHAR]) AS line, unnest([0, 1, 2, 3]) AS pos FROM documents)
    SELECT doc, page, pos, pos IN (0, 2, 3) AS furniture FROM l WHERE pos <> 1""",
)
def x30(spark, sf_dir):
    """Running heads, numbered feet and stepping page numbers; the line of text between them is left out of the comparison."""
    i = F.col("doc_id")
    parts = F.array(F.lit("Journal of Tests"), F.col("text"), F.concat(F.lit("end "), i.cast("string")), (F.floor(i / 20) + 5).cast("string"))
    lines = docs(spark, sf_dir).select((i % 20).alias("doc"), F.floor(i / 20).alias("page"), F.posexplode(parts).alias("pos", "line"))
    return pages.furniture(lines).filter("pos <> 1").select("doc", "page", "pos", "furniture")


@register(
    "x16_drop_sections",
    """WITH l AS (SELECT doc_id, unnest(['# T', 'a', '## References', 'r', '### Sub', 's', '## Methods', text, '# Funding', 'f']) AS line, generate_subscripts([1,2,3,4,5,6,7,8,9,10], 1) - 1 AS pos FROM documents)
    SELECT doc_id AS doc, pos::INTEGER AS pos, md5(line) AS line FROM l WHERE pos NOT IN (2, 3, 4, 5, 8, 9)""",
)
def x16(spark, sf_dir):
    parts = F.array(*[F.lit(x) for x in ("# T", "a", "## References", "r", "### Sub", "s", "## Methods")], F.col("text"), F.lit("# Funding"), F.lit("f"))
    lines = docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.posexplode(parts).alias("pos", "line"))
    return pages.without_back_matter(lines).select("doc", "pos", md5(F.col("line")).alias("line"))


@register(
    "f17_robots",
    "WITH u AS (SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host, regexp_extract(url, '://[^/]+(/[^?#]*)', 1) AS p FROM pages) SELECT page_id, CASE WHEN regexp_matches(p, '^/en/.*7') THEN true WHEN starts_with(p, '/en/') THEN false WHEN starts_with(p, '/fr') THEN true ELSE true END AS allowed FROM u",
)
def f17(spark, sf_dir):
    u = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/]+)", 1).alias("host"), F.regexp_extract("url", "://[^/]+(/[^?#]*)", 1).alias("p"))
    hosts = u.select("host").distinct()
    rules = spark.createDataFrame([("/en/", False), ("/en/*7", True), ("/fr", False), ("/fr", True)], "pattern string, allow boolean")
    return pages.allowed(u, hosts.join(F.broadcast(rules)), F.col("p")).select("page_id", "allowed")


@register(
    "f23_term_flags",
    "SELECT * FROM (VALUES ('gene', true, false, false), ('gene*', false, false, false), ('ab', false, true, false), ('x*', false, false, true)) t(term, duplicate, short_token, short_prefix)",
)
def f23(spark, sf_dir):
    d = keywords.dictionary(spark, ["gene", "gene*", "ab", "x*"])
    again = spark.createDataFrame([("gene", 2), ("gene*", 1), ("ab", 1), ("x*", 1)], "term string, times int")
    n = F.length(F.element_at("parts", -1))
    return d.join(again, "term").select("term", (F.col("times") > 1).alias("duplicate"), ((F.col("kind") == "word") & (n < 3)).alias("short_token"), (F.col("kind").isin("prefix") & (n < 3)).alias("short_prefix"))


@register(
    "f09_prefilter",
    f"SELECT doc_id, len(regexp_extract_all(lower(text), '(tion|ment|der)'))::BIGINT >= 3 AS may_pass FROM documents",
)
def f09(spark, sf_dir):
    """An upper bound of the hits in one regular-expression pass, ahead of the words."""
    return docs(spark, sf_dir).select("doc_id", (F.regexp_count(F.lower("text"), F.lit("(tion|ment|der)")) >= 3).alias("may_pass"))


@register(
    "f12_emptied",
    f"""WITH l AS (SELECT doc_id, source, pos, {STRIP('line')} AS line FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
    r AS (SELECT l.doc_id, l.pos, l.line, d.line IS NOT NULL AS gone FROM l LEFT JOIN (SELECT source, line FROM l WHERE line <> '' GROUP BY source, line HAVING count(DISTINCT doc_id) >= 2) d ON d.source = l.source AND d.line = l.line),
    t AS (SELECT doc_id, {SQUEEZE("coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')")} AS text FROM r GROUP BY doc_id)
    SELECT doc_id, length(text) < 200 AS emptied FROM t""",
)
def f12(spark, sf_dir):
    """Documents that the lines that others of their source have leave too short."""
    d = docs(spark, sf_dir)
    keyed = dedup.keyed_lines(d, "doc_id", "source")
    left = dedup.without_lines(d, "doc_id", keyed, repeated_lines(keyed))
    return left.select(F.col("id").alias("doc_id"), (F.length("text") < 200).alias("emptied"))


def repeated_lines(keyed):
    """(source, key): lines that two documents of a source have, by the smallest and the largest id."""
    return keyed.groupBy("source", "key").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a < z").select("source", "key")


_sql("f27_gwas_valid", "SELECT doc_id, TRY_CAST(CASE WHEN doc_id % 5 = 0 THEN 'NA' WHEN doc_id % 7 = 0 THEN '.' ELSE CAST(1.0 / (doc_id + 1) AS VARCHAR) END AS DOUBLE) IS NOT NULL AND doc_id % 11 <> 0 AS valid FROM documents",
     "SELECT doc_id, try_cast(CASE WHEN doc_id % 5 = 0 THEN 'NA' WHEN doc_id % 7 = 0 THEN '.' ELSE CAST(1.0D / (doc_id + 1) AS STRING) END AS DOUBLE) IS NOT NULL AND doc_id % 11 <> 0 AS valid FROM documents")
_sql("x29_repository_parts", "SELECT page_id, regexp_extract(url, '^https?://([^/]+)/([^/]+)', 2) AS owner, regexp_extract(url, '/([^/?]+)(?:[?]|$)', 1) AS repo FROM pages")
_sql("x31_reflow", "SELECT doc_id, md5(regexp_replace(text || ' hyphen-' || chr(10) || 'ated', '([a-z])-\\n([a-z])', '\\1\\2', 'g')) AS digest FROM documents",
     "SELECT doc_id, md5(regexp_replace(concat(text, ' hyphen-\\n', 'ated'), '([a-z])-\\n([a-z])', '$1$2')) AS digest FROM documents")
_sql("x21_script_tags", "SELECT page_id, length(regexp_replace(html || '<sup>2</sup><sub>i</sub>', '</?(sup|sub)>', '', 'g')) AS n FROM pages", "SELECT page_id, length(regexp_replace(concat(html, '<sup>2</sup><sub>i</sub>'), '</?(sup|sub)>', '')) AS n FROM pages")
_sql("k02_duplicates_table", "SELECT 'exact' AS kind, d.source, d.doc_id, k.source AS kept_source, k.doc_id AS kept_id FROM documents d JOIN (SELECT md5(text) AS h, min(doc_id) AS first FROM documents GROUP BY md5(text)) f ON md5(d.text) = f.h JOIN documents k ON k.doc_id = f.first WHERE d.doc_id <> f.first")
_sql("k08_joined_lists", "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ';' ORDER BY o_orderkey) AS orders FROM orders GROUP BY o_custkey", "SELECT o_custkey, array_join(transform(array_sort(collect_list(o_orderkey)), x -> CAST(x AS STRING)), ';') AS orders FROM orders GROUP BY o_custkey")
_sql("j18_earlier_row", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS earlier, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events")
_sql("u04_distinct_first", "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")


@register("tk06_pair_counts", f"""WITH w AS (SELECT doc_id, unnest(ws) AS t, generate_subscripts(ws, 1) AS k FROM (SELECT doc_id, regexp_extract_all(lower(text), '{tx.WORD}') AS ws FROM documents)),
p AS (SELECT lag(t) OVER (PARTITION BY doc_id ORDER BY k) AS a, t AS b FROM w) SELECT a, b, count(*)::BIGINT AS n FROM p WHERE a IS NOT NULL GROUP BY a, b HAVING count(*) >= 20""")
def tk06(spark, sf_dir):
    """Neighbouring words, made into pairs inside their document's array: no window, one shuffle."""
    return tokens.pair_counts(docs(spark, sf_dir), "text").filter("n >= 20")


@register("tk08_byte_table", f"SELECT t AS piece, octet_length(encode(t))::INTEGER AS bytes, regexp_matches(t, '[^\\x00-\\x7f]') AS wide FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{tx.WORD}')) AS t FROM documents)")
def tk08(spark, sf_dir):
    p = docs(spark, sf_dir).select(F.explode(tx.words(F.lower("text"))).alias("piece")).distinct()
    return p.select("piece", F.octet_length("piece").alias("bytes"), F.col("piece").rlike(r"[^\x00-\x7f]").alias("wide"))


@register("a04_frequent_sketch", "SELECT event_type, true AS close FROM events GROUP BY event_type")
def a04(spark, sf_dir):
    """Frequencies from a sketch of fixed size, against the exact ones."""
    e = table(spark, sf_dir, "events")
    top = e.agg(F.expr("approx_top_k(event_type, 10)").alias("t")).select(F.explode("t").alias("x")).select(F.col("x.item").alias("event_type"), F.col("x.count").alias("about"))
    exact = e.groupBy("event_type").agg(F.count("*").alias("n"))
    return exact.join(top, "event_type").select("event_type", (F.abs(F.col("n") - F.col("about")) <= 0.01 * F.col("n")).alias("close"))


@register("t07_length_batches")
def t07(spark, sf_dir):
    """Batches of similar length: rows in hash order are cut into mega-batches, sorted inside, and numbered."""
    return tokens.length_batches(docs(spark, sf_dir), "doc_id", "n_chars", 8)


@register("t10_nucleus", """WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY lang) AS p FROM c),
r AS (SELECT *, sum(p) OVER (PARTITION BY lang ORDER BY p DESC, source) - p AS before FROM p) SELECT lang, source, round(p, 6) AS p FROM r WHERE before < 0.5 - 1e-9""")
def t10(spark, sf_dir):
    from pyspark.sql.window import Window

    c = docs(spark, sf_dir).groupBy("lang", "source").agg(F.count("*").alias("n"))
    c = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    run = c.withColumn("before", F.sum("p").over(Window.partitionBy("lang").orderBy(F.desc("p"), "source")) - F.col("p"))
    return run.filter("before < 0.5 - 1e-9").select("lang", "source", F.round("p", 6).alias("p"))


@register("a08_group_chars", "SELECT source, key, count(*)::BIGINT AS size, sum(n_chars)::BIGINT AS chars FROM (SELECT source, md5(lower(text)) AS key, n_chars FROM documents) GROUP BY source, key")
def a08(spark, sf_dir):
    return docs(spark, sf_dir).select("source", md5(F.lower("text")).alias("key"), "n_chars").groupBy("source", "key").agg(F.count("*").alias("size"), F.sum("n_chars").alias("chars"))


@register("f14_navigation")
def f14(spark, sf_dir):
    from ..functions import convert

    p = table(spark, sf_dir, "pages").select("page_id", convert.html_page("html").alias("p"))
    return p.select("page_id", "p.link_share", (F.col("p.navigation") == 1).alias("navigation"))


@register(
    "s10_source_table",
    "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'bad name' WHEN page_id % 4 = 0 THEN 'unknown kind' WHEN page_id % 9 = 0 THEN 'bad url' END AS fault FROM pages",
)
def s10(spark, sf_dir):
    k = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select(
        "page_id",
        F.concat(F.when(k % 7 == 0, "-").otherwise("n"), k.cast("string")).alias("name"),
        F.when(k % 4 == 0, "blog").otherwise("site").alias("kind"),
        F.when(k % 9 == 0, "nowhere").otherwise(F.col("url")).alias("url"),
    )
    again = rows.select("name", "kind", "url")  # repeated rows are left out
    judged = readers.source_table(again.union(again))
    return judged.select(F.regexp_extract("name", "([0-9]+)$", 1).cast("long").alias("page_id"), "fault")


_sql("s19_search_page", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders",
     "SELECT o_custkey, r.id AS o_orderkey, r.s AS o_orderstatus FROM (SELECT o_custkey, explode(from_json(j, 'struct<hits:array<struct<id:bigint,s:string>>>').hits) AS r FROM (SELECT o_custkey, to_json(named_struct('hits', collect_list(named_struct('id', o_orderkey, 's', o_orderstatus)))) AS j FROM orders GROUP BY o_custkey))")
@register(
    "x17_pdf_back_matter",
    """WITH l AS (SELECT doc_id, unnest(['# Body', 'b', '# Funding', text, '# References', text || text, '# Appendix', 'z']) AS line, generate_subscripts([1,2,3,4,5,6,7,8], 1) - 1 AS pos, length(text) AS n FROM documents)
    SELECT doc_id AS doc, pos::INTEGER AS pos, md5(line) AS line FROM l WHERE pos NOT IN (4, 5) AND NOT (pos IN (2, 3) AND n + 9 <= 3000)""",
)
def x17(spark, sf_dir):
    parts = F.array(F.lit("# Body"), F.lit("b"), F.lit("# Funding"), F.col("text"), F.lit("# References"), F.concat("text", "text"), F.lit("# Appendix"), F.lit("z"))
    lines = docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.posexplode(parts).alias("pos", "line"))
    return pages.without_pdf_back_matter(lines).select("doc", "pos", md5(F.col("line")).alias("line"))


@register("x24_sample_windows")
def x24(spark, sf_dir):
    import pandas as pd

    from ..functions import convert

    def windows(batches):
        for pdf in batches:
            rows = [(i, w, len(p)) for i, t in zip(pdf["doc_id"], pdf["text"], strict=True) for w, p in convert.sample_windows(t or "")]
            yield pd.DataFrame(rows, columns=["doc_id", "window", "chars"])

    return docs(spark, sf_dir).select("doc_id", "text").mapInPandas(windows, "doc_id long, window long, chars long")


@register(
    "j19_nearest",
    """SELECT c.event_id, min_by(p.event_id, struct_pack(d := abs(p.event_id - c.event_id), e := p.event_id)) AS nearest
    FROM events c LEFT JOIN events p ON p.user_id = c.user_id AND p.event_type = 'purchase' WHERE c.event_type = 'click' GROUP BY c.event_id""",
)
def j19(spark, sf_dir):
    """For each click the nearest purchase of its user."""
    e = table(spark, sf_dir, "events")
    clicks = e.filter("event_type = 'click'").select("event_id", "user_id")
    return relational.nearest_by(clicks, e.filter("event_type = 'purchase'"), "user_id", "event_id").select("event_id", "nearest")


@register("a34_principal")
def a34_principal(spark, sf_dir):
    """The two leading principal coordinates of every embedding."""
    return vectors.principal(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")[0]


@register("p02_converted")
def p02(spark, sf_dir):
    """Pages as files of several kinds, each by its converter."""
    k = F.col("page_id") % 4
    path = F.concat(F.lit("p"), F.col("page_id").cast("string"), F.when(k == 0, ".html").when(k == 1, ".Rmd").when(k == 2, ".csv").otherwise(".bin"))
    files = table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.col("html").cast("binary").alias("content"))
    return markup.converted(files).select("page_id", "kind", F.md5(F.col("markdown").cast("binary")).alias("digest"))
