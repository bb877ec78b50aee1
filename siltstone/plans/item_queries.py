"""Queries on items, pairs, URLs and lists."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import unit, unit_sql
from ..operators import items
from .catalog import register
from .common import docs, md5, table
from .relational_queries import _sql

_OPT = "CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 6 = 1 THEN ['a'] WHEN doc_id % 6 = 2 THEN ['a', ''] WHEN doc_id % 6 = 3 THEN ['a', 'b', 'b'] ELSE ['a', 'b', 'c'] END"


@register(
    "f18_valid_items",
    f"""WITH i AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'q' END AS question, {_OPT} AS options, CASE WHEN doc_id % 4 = 0 THEN 'z' ELSE 'b' END AS answer, CASE WHEN doc_id % 13 = 0 THEN 'essay' WHEN doc_id % 5 = 0 THEN 'open' ELSE 'mcq' END AS kind FROM documents)
    SELECT doc_id, CASE WHEN question = '' THEN 'missing question' WHEN kind NOT IN ('mcq', 'code', 'numeric', 'open') THEN 'unknown kind ' || kind
      WHEN kind = 'mcq' AND coalesce(len(options), 0) < 2 THEN 'fewer than two options' WHEN kind = 'mcq' AND len(list_filter(options, lambda o: o = '')) > 0 THEN 'empty option'
      WHEN kind = 'mcq' AND NOT list_contains(options, answer) THEN 'answer not among the options' WHEN kind = 'mcq' AND len(list_filter(options, lambda o: o = answer)) > 1 THEN 'answer duplicated among the options'
      WHEN kind <> 'mcq' AND options IS NOT NULL THEN 'options must be null for non-MCQ items' END AS fault FROM i""",
)
def f18(spark, sf_dir):
    i = F.col("doc_id")
    lists = [F.array(*[F.lit(x) for x in xs]) for xs in (["a"], ["a", ""], ["a", "b", "b"], ["a", "b", "c"])]
    options = F.when(i % 6 == 1, lists[0]).when(i % 6 == 2, lists[1]).when(i % 6 == 3, lists[2]).when(i % 6 != 0, lists[3])
    kind = F.when(i % 13 == 0, "essay").when(i % 5 == 0, "open").otherwise("mcq")
    fault = items.item_fault(i, F.when(i % 11 == 0, "").otherwise("q"), options, F.when(i % 4 == 0, "z").otherwise("b"), F.col("lang"), kind)
    return docs(spark, sf_dir).select("doc_id", fault.alias("fault"))


@register("t03_hash_topk", "SELECT item_id, row_number() OVER (ORDER BY sha256('bench|' || item_id), item_id)::INTEGER AS rank FROM benchmark QUALIFY rank <= 10")
def t03(spark, sf_dir):
    top = items.hash_top(table(spark, sf_dir, "benchmark"), "bench", "item_id", 10)
    return top.select("item_id", F.row_number().over(Window.orderBy("h", "item_id")).alias("rank"))


_U = unit_sql("'4'", "'keep'", "doc_id")


@register("t04_priority_budget", f"SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY {_U} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM documents) WHERE coalesce(before, 0) < 300000")
def t04(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "n_chars")
    return items.budget_sample(d, unit("4", "keep", F.col("doc_id")), "n_chars", 300_000)


_sql("t05_hold_out", "SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) % 5 AS BIGINT) = 0 AS held_out FROM documents")
_sql("t06_systematic", "SELECT doc_id, source FROM documents WHERE doc_id % 7 = 3")
_sql("t09_round_robin", "SELECT source, CAST(k % 4 AS BIGINT) AS worker FROM (SELECT source, row_number() OVER (ORDER BY n DESC, source) - 1 AS k FROM (SELECT source, sum(n_chars) AS n FROM documents GROUP BY source) a) b")


@register("w11_even_sample", "WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM documents) SELECT doc_id FROM o WHERE place IN (SELECT floor(range * (n - 1) / 16)::BIGINT FROM range(0, 17), (SELECT any_value(n) AS n FROM o))")
def w11(spark, sf_dir):
    return items.even_sample(docs(spark, sf_dir).select("doc_id"), "doc_id", 17).select("doc_id")


@register("s16_newest_copy", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def s16(spark, sf_dir):
    return items.newest(table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id"), ["user_id", "event_type"], "value", "event_id")


_sql("j12_todo", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND d.lang = 'en'")
_sql("j11_late_materialisation", "SELECT d.doc_id, length(d.text) AS n FROM documents d JOIN (SELECT doc_id FROM labels WHERE quality = 1 ORDER BY doc_id DESC LIMIT 50) t ON d.doc_id = t.doc_id")
_sql("j14_groups", "WITH g AS (SELECT * FROM (VALUES ('src1', 2, 'wide'), ('src10', 1, 'narrow'), ('src', 9, 'rest')) AS t(prefix, prio, grp)) SELECT doc_id, grp FROM (SELECT doc_id, grp, row_number() OVER (PARTITION BY doc_id ORDER BY prio) AS rn FROM documents JOIN g ON substring(source, 1, length(prefix)) = prefix) x WHERE rn = 1")
_sql("j15_modules", "SELECT doc_id, list_has_any([source, lang], ['src3', 'fr']) AS skip FROM documents", "SELECT doc_id, arrays_overlap(array(source, lang), array('src3', 'fr')) AS skip FROM documents")
_sql("j23_weighted_sources", "SELECT d.source, round(sum(d.n_chars) * max(w.weight), 3) AS mass FROM documents d JOIN (SELECT 'src' || CAST(n_nationkey AS VARCHAR) AS source, CAST(n_regionkey + 1 AS DOUBLE) AS weight FROM nation) w ON d.source = w.source GROUP BY d.source",
     "SELECT d.source, round(sum(d.n_chars) * max(w.weight), 3) AS mass FROM documents d JOIN (SELECT concat('src', CAST(n_nationkey AS STRING)) AS source, CAST(n_regionkey + 1 AS DOUBLE) AS weight FROM nation) w ON d.source = w.source GROUP BY d.source", "documents", "nation")


@register(
    "x26_normalise_url",
    r"""WITH u AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN replace(url, '.example', '.EXAMPLE') || '#frag' WHEN page_id % 5 = 1 THEN regexp_replace(url, '^(https?://[^/]+).*$', '\1:443') WHEN page_id % 5 = 2 THEN regexp_replace(url, '^(https?://[^/]+)', '\1:8080') WHEN page_id % 5 = 3 THEN 'ftp' || url ELSE url END AS url FROM pages)
    SELECT page_id, CASE WHEN page_id % 5 = 3 THEN NULL WHEN page_id % 5 = 1 THEN regexp_replace(url, ':443$', '') || '/' ELSE replace(split_part(url, '#', 1), '.EXAMPLE', '.example') END AS url FROM u""",
)
def x26(spark, sf_dir):
    p, u = F.col("page_id"), F.col("url")
    given = (
        F.when(p % 5 == 0, F.concat(F.replace(u, F.lit(".example"), F.lit(".EXAMPLE")), F.lit("#frag"))).when(p % 5 == 1, F.regexp_replace(u, "^(https?://[^/]+).*$", "$1:443"))
        .when(p % 5 == 2, F.regexp_replace(u, "^(https?://[^/]+)", "$1:8080")).when(p % 5 == 3, F.concat(F.lit("ftp"), u)).otherwise(u)
    )
    return table(spark, sf_dir, "pages").select("page_id", items.normalised_url(given).alias("url"))


_sql("x27_scope", "SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host, starts_with(url, 'https://') AS secure, regexp_extract(split_part(url, '?', 1), '[.]([A-Za-z0-9]+)$', 1) AS ext FROM pages",
     "SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host, startswith(url, 'https://') AS secure, regexp_extract(split_part(url, '?', 1), '[.]([A-Za-z0-9]+)$', 1) AS ext FROM pages")
_sql("f15_skip_url", "SELECT page_id, regexp_matches(url, '[?&](replytocom|share|print|format|action|utm_[a-z]+)=') AS skip FROM pages", "SELECT page_id, url RLIKE '[?&](replytocom|share|print|format|action|utm_[a-z]+)=' AS skip FROM pages")


@register(
    "x28_file_stem",
    r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '(?i)\.(md|markdown|rst|rmd|txt|html?|ipynb|pdf|rd|tex)$', '') AS plain FROM pages), s AS (SELECT page_id, plain, array_to_string(list_filter(list_transform(list_filter(regexp_split_to_array(plain, '[\\/]+'), lambda x: x NOT IN ('', '.', '..')),
      lambda x: regexp_replace(regexp_replace(x, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g')), lambda x: x <> ''), '__') AS stem FROM p)
    SELECT page_id, CASE WHEN length(stem) > 100 THEN regexp_replace(substr(stem, 1, 90), '[._-]+$', '') || '_' || substr(sha1(plain), 1, 8) ELSE stem END AS stem FROM s""",
)
def x28(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", items.file_stem(F.regexp_replace("url", "^https?://", "")).alias("stem"))


@register(
    "s29_fence",
    r"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || '````' || chr(10) ELSE text END AS s FROM documents)
    SELECT doc_id, md5(f || 'py' || chr(10) || regexp_replace(s, '\n+$', '') || chr(10) || f) AS digest FROM (SELECT *, repeat('`', greatest(coalesce(list_max(list_transform(regexp_extract_all(s, '`{3,}'), lambda x: length(x))), 2) + 1, 3)) AS f FROM t)""",
)
def s29(spark, sf_dir):
    s = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n````\n"))).otherwise(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", md5(items.fenced(s, "py")).alias("digest"))


@register(
    "s24_notebook",
    "SELECT item_id, md5('# T' || chr(10) || text || chr(10) || chr(10) || '```python' || chr(10) || 'print(1)' || chr(10) || '```') AS digest FROM benchmark",
)
def s24(spark, sf_dir):
    cell = lambda kind, *parts: F.struct(F.lit(kind).alias("cell_type"), F.array(*parts).alias("source"))
    cells = F.array(cell("markdown", F.lit("# T\n"), F.col("text")), cell("code", F.lit("print(1)\n")), cell("markdown", F.lit("  ")), cell("raw", F.lit("x")))
    raw = F.to_json(F.struct(cells.alias("cells")))
    return table(spark, sf_dir, "benchmark").select("item_id", md5(items.notebook_markdown(raw)).alias("digest"))


_sql("s06_tolerant_json", "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'invalid_json' WHEN json_extract_string(props, '$.k') IS NULL THEN 'missing_text' ELSE '' END AS reason FROM events",
     "SELECT event_id, CASE WHEN v IS NULL THEN 'invalid_json' WHEN variant_get(v, '$.k', 'string') IS NULL THEN 'missing_text' ELSE '' END AS reason FROM (SELECT event_id, try_parse_json(CASE WHEN event_id % 10 = 0 THEN substring(props, 1, 3) ELSE props END) AS v FROM events)")
_sql("s18_rest_page", "SELECT user_id, unnest(list(event_id ORDER BY event_id)) AS event_id FROM events GROUP BY user_id",
     "SELECT user_id, explode(from_json(j, 'struct<collection:array<bigint>>').collection) AS event_id FROM (SELECT user_id, to_json(named_struct('collection', collect_list(event_id))) AS j FROM events GROUP BY user_id)")
_sql("s13_probe_rows", "SELECT item_id, 'c' || CAST(item_id % 3 AS VARCHAR) AS category, split_part(text, ' ', 1) AS prompt, 2 AS n_distractors FROM benchmark",
     "SELECT item_id, p[0] AS category, p[1] AS prompt, size(split(p[2], '[|]')) AS n_distractors FROM (SELECT item_id, split(concat('c', CAST(item_id % 3 AS STRING), '\\t', split_part(text, ' ', 1), '\\t', 'x|y'), '\\t') AS p FROM benchmark)")
_sql("s09_last_status", "SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey", "SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey")
_sql("x33_templates", "SELECT item_id, md5('### Question:' || chr(10) || split_part(text, chr(10), 1) || chr(10) || chr(10) || '### Answer:' || chr(10)) AS prompt FROM benchmark",
     "SELECT item_id, md5(format_string('### Question:\\n%s\\n\\n### Answer:\\n', split_part(text, '\\n', 1))) AS prompt FROM benchmark")
_sql("x34_first_number", "SELECT event_id, TRY_CAST(replace(regexp_extract('about ' || props, '(-?[0-9][0-9,]*[.]?[0-9]*)', 1), ',', '') AS DOUBLE) AS n FROM events",
     "SELECT event_id, try_cast(replace(regexp_extract(concat('about ', props), '(-?[0-9][0-9,]*[.]?[0-9]*)', 1), ',', '') AS DOUBLE) AS n FROM events")
_sql("x36_dates", "SELECT o_orderkey, strftime(strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d'), '%Y-%m-%d') AS iso, strftime(least(o_orderdate + INTERVAL 29 DAY, TIMESTAMP '1998-01-01'), '%Y-%m-%d') AS window_end FROM orders",
     "SELECT o_orderkey, date_format(to_date(date_format(o_orderdate, 'yyyyMMdd'), 'yyyyMMdd'), 'yyyy-MM-dd') AS iso, date_format(least(o_orderdate + INTERVAL 29 DAY, TIMESTAMP_NTZ '1998-01-01'), 'yyyy-MM-dd') AS window_end FROM orders")


@register("x32_shuffled_prompt", "SELECT item_id, md5(array_to_string(list_transform(list_sort(list_transform(range(0, len(w)), lambda i: {'h': md5('3' || chr(31) || i::VARCHAR || chr(31) || w[i + 1]), 'i': i, 'w': w[i + 1]})), lambda x: x.w), ' ')) AS digest FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)")
def x32(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", md5(items.shuffled_prompt(F.col("text"), 3)).alias("digest"))


@register("x38_first_turns", "SELECT conv_id, md5(arg_min(text, turn) FILTER (WHERE role = 'user')) AS prompt, md5(arg_min(text, turn) FILTER (WHERE role = 'assistant')) AS response FROM conversations GROUP BY conv_id")
def x38(spark, sf_dir):
    by = lambda role: md5(F.min_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(by("user").alias("prompt"), by("assistant").alias("response"))


_PAIRS = "p AS (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS prompt, arg_min(text, turn) FILTER (WHERE role = 'assistant') AS response FROM conversations GROUP BY conv_id)"


def _pairs(spark, sf_dir):
    by = lambda role: F.min_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(by("user").alias("prompt"), by("assistant").alias("response"))


@register("f22_pair_filter", f"WITH {_PAIRS} SELECT conv_id FROM p WHERE prompt IS NOT NULL AND response IS NOT NULL AND length(prompt) BETWEEN 20 AND 1000 AND length(response) <= 2000 AND prompt <> response")
def f22(spark, sf_dir):
    return _pairs(spark, sf_dir).filter(F.length("prompt").between(20, 1000) & (F.length("response") <= 2000) & (F.col("prompt") != F.col("response"))).select("conv_id")


@register("j13_contamination", f"WITH {_PAIRS}, e AS (SELECT DISTINCT lower(split_part(prompt, chr(10), 1)) AS line FROM p WHERE conv_id % 5 = 0) SELECT conv_id FROM p WHERE prompt IS NOT NULL AND lower(split_part(prompt, chr(10), 1)) NOT IN (SELECT line FROM e WHERE line IS NOT NULL)")
def j13(spark, sf_dir):
    p = _pairs(spark, sf_dir).filter("prompt is not null").withColumn("line", F.lower(F.substring_index("prompt", "\n", 1)))
    return p.join(p.filter("conv_id % 5 = 0").select("line"), "line", "left_anti").select("conv_id")


@register(
    "x39_pair_layout",
    f"""WITH {_PAIRS}, t AS (SELECT conv_id, list_transform(string_split(prompt, ' '), lambda w: length(w)::INTEGER) AS q, list_transform(string_split(response, ' '), lambda w: length(w)::INTEGER) || [2::INTEGER] AS a FROM p WHERE prompt IS NOT NULL AND response IS NOT NULL),
    c AS (SELECT *, len(q) + len(a) > 32 AS truncated, CASE WHEN len(q) + len(a) > 32 THEN a[1:greatest(1, 32 - least(len(q), 16))] ELSE a END AS ca FROM t), d AS (SELECT *, CASE WHEN truncated AND len(q) > 32 - len(ca) THEN q[len(q) - (32 - len(ca)) + 1:] ELSE q END AS cq FROM c)
    SELECT conv_id, (len(cq) + 1)::INTEGER AS n_prompt, truncated, array_to_string([1] || cq || ca, ',') AS ids FROM d""",
)
def x39(spark, sf_dir):
    p = _pairs(spark, sf_dir).dropna()
    n = lambda c: F.transform(F.split(c, " "), lambda w: F.length(w))
    made = items.pair_layout(n("prompt"), n("response"), 32)
    return p.select("conv_id", made["n_prompt"].alias("n_prompt"), made["truncated"].alias("truncated"), F.array_join(F.transform(made["ids"], lambda x: x.cast("string")), ",").alias("ids"))


_sql("f25_status", "SELECT o_orderkey, regexp_matches(o_orderpriority, '^[12]-') AS finished, o_orderstatus IN ('F', 'P') AS final FROM orders", "SELECT o_orderkey, o_orderpriority RLIKE '^[12]-' AS finished, o_orderstatus IN ('F', 'P') AS final FROM orders")
_sql("f16_repo_action", "SELECT page_id, CASE WHEN regexp_matches(url, '/(test|vendor)/') THEN NULL WHEN regexp_matches(url, '[.](md|markdown)$') THEN 'md' WHEN regexp_matches(url, '[.]html?$') THEN 'html' WHEN length(html) = 0 THEN NULL ELSE 'txt' END AS action FROM pages",
     "SELECT page_id, CASE WHEN exists(split(url, '/'), p -> p IN ('test', 'vendor')) THEN NULL WHEN url RLIKE '[.](md|markdown)$' THEN 'md' WHEN url RLIKE '[.]html?$' THEN 'html' WHEN length(html) = 0 THEN NULL ELSE 'txt' END AS action FROM pages")
_sql("f21_language_prefix", "SELECT doc_id, starts_with(lang, 'en') OR lang = '' AS english FROM documents", "SELECT doc_id, startswith(lang, 'en') OR lang = '' AS english FROM documents")
_sql("f20_density", "SELECT doc_id, round(1000 * len(regexp_extract_all(text, '(tion)'))::DOUBLE / greatest(len(regexp_extract_all(text, '[^ \\n]+')), 1), 6) AS density FROM documents",
     "SELECT doc_id, round(1000 * CAST(regexp_count(text, '(tion)') AS DOUBLE) / greatest(regexp_count(text, '[^ \\\\n]+'), 1), 6) AS density FROM documents")
_sql("k07_token_counts", "SELECT tok, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS tok FROM benchmark) t GROUP BY tok", "SELECT tok, count(*) AS n FROM (SELECT explode(split(lower(text), ' ')) AS tok FROM benchmark) GROUP BY tok")
_sql("k04_manifest", "SELECT count(*) AS documents, sum(n_chars) AS chars, count(DISTINCT source) AS sources, max(n_chars) AS longest FROM documents")
