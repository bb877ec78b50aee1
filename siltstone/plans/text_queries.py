"""Queries on the text of documents: cleaning (X), tests (F), content keys."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import hashing, text as tx
from ..operators import decisions
from ..session import staged
from .catalog import register
from .common import CLEAN, CONTROLS, KEY, NEWLINES, RAW_SQL, S, SQUASH, SQUEEZE, STRIP, docs, md5, raw, table, word_list


def _rewritten(name: str, change, sql: str, of: str = RAW_SQL) -> None:
    """A query of doc_id, and the digest and length of what ``change`` makes of a dirtied text."""

    @register(name, f"SELECT doc_id, md5(t) AS digest, length(t)::BIGINT AS n FROM (SELECT doc_id, {sql.replace('$T', f'({of})')} AS t FROM documents)")
    def run(spark, sf_dir):
        t = change(F.col("text"))
        return raw(docs(spark, sf_dir)).select("doc_id", md5(t).alias("digest"), F.length(t).cast("long").alias("n"))


_rewritten("x02_bom", tx.without_bom, "ltrim($T, chr(65279))")
_rewritten("x03_newlines", tx.unix_newlines, NEWLINES("$T"))
_rewritten("x04_nfc", tx.nfc, "nfc_normalize($T)")
_rewritten("x05_marker", tx.without_marker, "replace($T, chr(9601), '_')")
_rewritten("x06_control", tx.without_controls, CONTROLS("$T"))
_rewritten("x07_blank_runs", tx.squeezed, SQUEEZE("$T"))
_rewritten("x12_squash", tx.squashed, SQUASH("$T"))
_rewritten("x13_tidy", tx.tidied, STRIP("regexp_replace(regexp_replace($T, '(?m)[ \\t]+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"))
_rewritten("x15_mask_email", tx.masked_emails, "regexp_replace($T, '[\\w.+-]+@[\\w-]+(\\.[\\w-]+)+', '[email]', 'g')")
_rewritten(
    "x20_strip_markup",
    lambda t: tx.without_markup(F.concat(t, F.lit("![a](b) [c](d)<!-- e\nf --><b class='x'>g</b>"))),
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace($T || '![a](b) [c](d)<!-- e' || chr(10) || 'f --><b class=''x''>g</b>',"
    " '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '<!--.*?-->', '', 'gs'), '</?[A-Za-z][^>]*>', '', 'g')",
)
_rewritten("x37_home_mask", lambda t: tx.home_masked(F.concat(F.lit("/home/ann/x /Users/bo/y "), t)), "regexp_replace('/home/ann/x /Users/bo/y ' || $T, '(/home|/Users)/[^/\\s]+', '~', 'g')")
_rewritten("k10_tsv_cell", tx.tsv_cell, "translate($T, chr(9) || chr(13) || chr(10), '   ')")


@register(
    "x08_mojibake",
    rf"SELECT doc_id, regexp_matches(CASE WHEN doc_id % 3 = 0 THEN {RAW_SQL} ELSE text END, '[\x{{C2}}\x{{C3}}][\x{{80}}-\x{{BF}}]') AS suspect FROM documents",
)
def x08(spark, sf_dir):
    d = docs(spark, sf_dir)
    dirty = raw(d.withColumn("plain", F.col("text")))
    return dirty.select("doc_id", tx.mojibake(F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.col("plain"))).alias("suspect"))


@register(
    "x09_clean_text",
    f"""
    SELECT doc_id, md5({CLEAN('t')}) AS digest, t <> ltrim(t, chr(65279)) AS had_bom,
           ltrim(t, chr(65279)) <> {NEWLINES('ltrim(t, chr(65279))')} AS had_cr,
           length(t) - length(replace(t, chr(9601), '')) AS n_markers,
           length({NEWLINES('ltrim(t, chr(65279))')}) - length({CONTROLS(NEWLINES('ltrim(t, chr(65279))'))}) AS n_controls,
           regexp_matches({CONTROLS(NEWLINES('ltrim(t, chr(65279))'))}, '[\\x{{C2}}\\x{{C3}}][\\x{{80}}-\\x{{BF}}]') AS mojibake
    FROM (SELECT doc_id, {RAW_SQL} AS t FROM documents)
    """,
)
def x09(spark, sf_dir):
    t = F.col("text")
    changes = tx.cleaning_changes(t)
    return raw(docs(spark, sf_dir)).select("doc_id", md5(tx.cleaned(t)).alias("digest"), *[c.alias(n) for n, c in changes.items()])


_BAD = "text || chr(10) || repeat(chr(65533), 8) || 'ab' || chr(10) || 'a long line with one ' || chr(65533) || ' in it'"


@register(
    "x10_replacement_lines",
    f"""
    SELECT doc_id, md5({SQUEEZE("replace(array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT (length(x) - length(replace(x, chr(65533), '')) > 0 AND (length(x) - length(replace(x, chr(65533), ''))) * 5 >= length(regexp_replace(x, '" + S + "', '', 'g')))), chr(10)), chr(65533), '')")}) AS digest,
           round((length(t) - length(replace(t, chr(65533), '')))::DOUBLE / greatest(length(t), 1), 6) AS ratio
    FROM (SELECT doc_id, {_BAD} AS t FROM documents)
    """,
)
def x10(spark, sf_dir):
    t = F.concat("text", F.lit("\n" + "�" * 8 + "ab\na long line with one � in it"))
    return docs(spark, sf_dir).select("doc_id", md5(tx.repaired(t)).alias("digest"), F.round(tx.replacement_ratio(t), 6).alias("ratio"))


@register(
    "x23_next_nonblank",
    f"""
    WITH lines AS (
      SELECT doc_id, unnest(string_split(text || chr(10) || chr(10) || 'last', chr(10))) AS line,
             generate_subscripts(string_split(text || chr(10) || chr(10) || 'last', chr(10)), 1) - 1 AS pos FROM documents
    ), s AS (SELECT doc_id, pos, {STRIP('line')} AS line FROM lines)
    SELECT doc_id, pos::INTEGER AS pos, md5(line) AS line,
           md5(coalesce(first_value(CASE WHEN line <> '' THEN line END IGNORE NULLS)
             OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '')) AS next_line
    FROM s
    """,
)
def x23(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("text", F.concat("text", F.lit("\n\nlast")))
    lines = decisions.with_next_line(decisions.lines(d, "doc_id"), "doc_id")
    return lines.select("doc_id", "pos", md5(F.col("line")).alias("line"), md5(F.col("next_line")).alias("next_line"))


_HEAD = f"list_filter(regexp_extract_all(substr(text, 1, 8000), '{tx.LETTER_WORD}'), lambda w: true)"
_MIDDLE = f"regexp_extract_all(substr(text, (length(text) // 2 + 1)::BIGINT, 8000), '{tx.LETTER_WORD}')"
_KNOWN = word_list(tx.ENGLISH_WORDS)
_SHARE = lambda w: f"(len(list_filter({w}, lambda w: list_contains({_KNOWN}, lower(w))))::DOUBLE / greatest(len({w}), 1))"
ENGLISH_SQL = (
    f"(len({_HEAD}) < 50 OR {_SHARE(_HEAD)} >= 0.10::DOUBLE OR"
    f" length(regexp_replace(array_to_string({_HEAD}, ''), '[\\x00-\\x7f]', '', 'g'))::DOUBLE / greatest(length(array_to_string({_HEAD}, '')), 1) <= 0.005::DOUBLE"
    f" OR (len({_MIDDLE}) >= 50 AND {_SHARE(_MIDDLE)} >= 0.10::DOUBLE))"
)


@register("f01_english", f"SELECT doc_id, {ENGLISH_SQL} AS english FROM documents")
def f01(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.looks_english(F.col("text")).alias("english"))


@register(
    "f02_replacement_ratio",
    "SELECT doc_id, (length(t) - length(replace(t, chr(65533), '')))::DOUBLE / greatest(length(t), 1) > 0.02 AS reject"
    " FROM (SELECT doc_id, text || repeat(chr(65533), (doc_id % 40)::INTEGER) AS t FROM documents)",
)
def f02(spark, sf_dir):
    t = F.concat("text", F.repeat(F.lit("�"), (F.col("doc_id") % 40).cast("int")))
    return docs(spark, sf_dir).select("doc_id", (tx.replacement_ratio(t) > 0.02).alias("reject"))


@register("f03_length", "SELECT doc_id, CASE WHEN length(text) = 0 THEN 'empty' WHEN length(text) < 200 THEN 'too_short' ELSE '' END AS reason FROM documents")
def f03(spark, sf_dir):
    n = F.length("text")
    return docs(spark, sf_dir).select("doc_id", F.when(n == 0, "empty").when(n < 200, "too_short").otherwise("").alias("reason"))


@register(
    "f06_min_score",
    "SELECT doc_id, quality FROM labels WHERE coalesce(CASE WHEN doc_id % 7 = 0 THEN NULL ELSE quality END::DOUBLE, -1e30) >= 1",
)
def f06(spark, sf_dir):
    score = F.when(F.col("doc_id") % 7 != 0, F.col("quality"))
    return table(spark, sf_dir, "labels").filter(decisions.passes_score(score, 1.0)).select("doc_id", "quality")


@register("f07_hash_sample", f"SELECT doc_id, source FROM documents WHERE {hashing.unit_sql(chr(39) + '58' + chr(39), chr(39) + 'sample' + chr(39), 'source', 'doc_id')} < 0.25")
def f07(spark, sf_dir):
    return docs(spark, sf_dir).filter(hashing.unit("58", "sample", F.col("source"), F.col("doc_id")) < 0.25).select("doc_id", "source")


@register("f08_glob", r"SELECT page_id, regexp_matches(lower(split_part(url, '?', 1)), '^(.*example\.org/en/.*|.*[0-9]7)$') AS excluded FROM pages")
def f08(spark, sf_dir):
    path = F.substring_index("url", "?", 1)
    return table(spark, sf_dir, "pages").select("page_id", decisions.excluded(path, ["*Example.org/en/*", "*[0-9]7"]).alias("excluded"))


_LINES_SQL = f"""
lines AS (
  SELECT doc_id, source, {STRIP('line')} AS line, pos FROM (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
), nexts AS (
  SELECT *, coalesce(first_value(CASE WHEN line <> '' THEN line END IGNORE NULLS)
    OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS next_line FROM lines
), marked AS (
  SELECT *, regexp_matches(line, '[A-Za-z0-9]') AND NOT starts_with(line, '#') AND NOT contains(line, '$$')
    AND NOT contains(line, '\\begin{{') AND NOT contains(line, '\\end{{')
    AND (len(string_split({SQUASH('line')}, ' ')) > 8 OR (NOT (line = upper(line) AND line <> lower(line))
      AND NOT (regexp_matches(line, '^[\\p{{L}}\\p{{N}}]') AND NOT regexp_matches(line, '[<>|`]') AND NOT regexp_matches(line, '[.!?;:,]$') AND length(next_line) >= 80))) AS candidate
  FROM nexts
)"""


@register("f11_boilerplate_rule", f"WITH {_LINES_SQL} SELECT doc_id, pos::INTEGER AS pos, candidate FROM marked WHERE line <> ''")
def f11(spark, sf_dir):
    lines = decisions.with_next_line(decisions.lines(docs(spark, sf_dir), "doc_id"), "doc_id").filter("line <> ''")
    return lines.select("doc_id", "pos", tx.boilerplate_candidate(F.col("line"), F.col("next_line")).alias("candidate"))


@register(
    "f13_prose",
    f"""
    WITH s AS (SELECT doc_id, substr(text, 1, 20000) AS t FROM documents), m AS (
      SELECT doc_id, regexp_replace(t, '{S}', '', 'g') AS solid, regexp_extract_all(t, '[A-Za-z]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: length({STRIP('x')}) > 0) AS ls FROM s)
    SELECT doc_id, length(regexp_replace(solid, '\\P{{L}}', '', 'g')) >= 0.6 * length(solid) AND length(solid) > 0 AND len(w) >= 30
      AND len(list_filter(w, lambda x: list_contains({word_list(tx.COMMON_WORDS)}, lower(x)))) >= 0.05 * len(w)
      AND (len(ls) = 0 OR len(list_filter(ls, lambda x: contains(x, chr(9)))) < 0.5 * len(ls)) AS prose FROM m
    """,
)
def f13(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.looks_like_prose(F.col("text")).alias("prose"))


@register(
    "f19_punctuated",
    r"SELECT doc_id, len(regexp_extract_all(text, '[^\s]+')) < 60 OR len(regexp_extract_all(text, '[.!?](\s|$)')) * 40 >= len(regexp_extract_all(text, '[^\s]+')) AS ok FROM documents",
)
def f19(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.punctuated(F.col("text")).alias("ok"))


@register("d01_content_key", f"SELECT doc_id, {KEY('text')} AS key FROM documents")
def d01(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", hashing.content_key(F.col("text")).alias("key"))


@register("w02_first_copy", f"SELECT doc_id, first_value(doc_id) OVER (PARTITION BY {KEY('text')} ORDER BY doc_id) AS first_id FROM documents")
def w02(spark, sf_dir):
    keyed = staged(docs(spark, sf_dir).select("doc_id", hashing.content_key(F.col("text")).alias("key")), "keyed")
    return decisions.first_copies(keyed, "key", "doc_id").select("doc_id", F.col("first").alias("first_id"))


_COPIES = f"k AS (SELECT doc_id, source, {KEY('text')} AS key, substr(text, 1, 60) AS title FROM documents), f AS (SELECT key, min(doc_id) AS first_id, count(*) AS n FROM k GROUP BY key)"


@register(
    "d02_exact_duplicates",
    f"WITH {_COPIES} SELECT k.doc_id, k.source, f.first_id AS kept_id, o.source AS kept_source, md5(o.title) AS kept_title FROM k JOIN f USING (key) JOIN k o ON o.doc_id = f.first_id WHERE k.doc_id <> f.first_id",
)
def d02(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "source", F.substring("text", 1, 60).alias("title"), hashing.content_key(F.col("text")).alias("key"))
    d = staged(d, "keyed")
    found = decisions.first_copies(d, "key", "doc_id").filter("doc_id <> first").select("doc_id", "source", F.col("first").alias("kept_id"))
    kept = d.select(F.col("doc_id").alias("kept_id"), F.col("source").alias("kept_source"), md5(F.col("title")).alias("kept_title"))
    return found.join(kept, "kept_id").select("doc_id", "source", "kept_id", "kept_source", "kept_title")


@register("f26_placeholders", f"WITH {_COPIES} SELECT key, n::BIGINT AS n, first_id FROM f WHERE n >= 5")
def f26(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", hashing.content_key(F.col("text")).alias("key"))
    return d.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n >= 5")


@register(
    "a01_counts_by_reason",
    f"""
    WITH c AS (SELECT doc_id, source, {CLEAN(RAW_SQL)} AS text FROM documents),
    e AS (SELECT *, {ENGLISH_SQL} AS english, {KEY('text')} AS key FROM c),
    r AS (SELECT *, CASE WHEN NOT english THEN 'not_english' WHEN length(text) = 0 THEN 'empty' WHEN length(text) < 200 THEN 'too_short' END AS early FROM e),
    k AS (SELECT *, row_number() OVER (PARTITION BY early IS NULL, key ORDER BY doc_id) AS rn FROM r),
    z AS (SELECT source, coalesce(early, CASE WHEN rn > 1 THEN 'exact_duplicate' ELSE 'kept' END) AS reason, length(text) AS chars FROM k)
    SELECT source, reason, count(*)::BIGINT AS documents, sum(chars)::BIGINT AS chars FROM z GROUP BY source, reason
    """,
)
def a01(spark, sf_dir):
    """The flagship: clean, decide with reasons, drop copies, count."""
    d = raw(docs(spark, sf_dir)).select("doc_id", "source", F.col("text").alias("given"))
    cleaned = tx.computed(d, "text", tx.cleaned(F.col("given"))).drop("given")
    decided = decisions.decided(cleaned, "doc_id", "text")
    return decided.groupBy("source", "reason").agg(F.count("*").alias("documents"), F.sum("chars").alias("chars"))


@register(
    "w01_rank_in_source",
    "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id)::INTEGER AS rank FROM"
    " (SELECT doc_id, source, round(len(regexp_extract_all(text, '(the|la|der)')) / sqrt(greatest(length(text), 500)), 6) AS score FROM documents)",
)
def w01(spark, sf_dir):
    hits = F.regexp_count("text", F.lit("(the|la|der)"))
    scored = docs(spark, sf_dir).select("doc_id", "source", F.round(hits / F.sqrt(F.greatest(F.length("text"), F.lit(500))), 6).alias("score"))
    w = Window.partitionBy("source").orderBy(F.desc("score"), "doc_id")
    return scored.select("doc_id", "source", F.row_number().over(w).alias("rank"))


@register(
    "f10_first_n",
    f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents WHERE length(text) >= 200) WHERE rn <= 5",
)
def f10(spark, sf_dir):
    kept = docs(spark, sf_dir).filter(F.length("text") >= 200)
    return decisions.first_n(kept, "source", "doc_id", 5).select("doc_id", "source")
