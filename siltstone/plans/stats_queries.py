"""Queries on evaluation and run statistics; scores are made from keys, the same way in both engines."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window


from ..functions.hashing import unit, unit_sql
from ..operators import evalstats, relational
from ..session import staged
from .catalog import register
from .common import docs, table
from .relational_queries import _sql

_ITEMS = f"items AS (SELECT doc_id, lang AS category, CASE WHEN n_chars > 2000 THEN ['long', source] ELSE [source] END AS tags, {unit_sql(chr(39) + 'c' + chr(39), 'doc_id')} < 0.6 AS correct, 0.25::DOUBLE AS chance FROM documents)"


def _items(spark, sf_dir):
    tags = F.when(F.col("n_chars") > 2000, F.array(F.lit("long"), F.col("source"))).otherwise(F.array("source"))
    return docs(spark, sf_dir).select("doc_id", F.col("lang").alias("category"), tags.alias("tags"), (unit("c", F.col("doc_id")) < 0.6).alias("correct"), F.lit(0.25).alias("chance"))


_WILSON = "round(greatest(0, (k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 6) AS low, round(least(1, (k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 6) AS high"


@register(
    "a17_accuracy_grouping_sets",
    f"""WITH {_ITEMS}, r AS (SELECT NULL::VARCHAR AS tag, NULL::VARCHAR AS category, correct, chance FROM items UNION ALL SELECT NULL, category, correct, chance FROM items UNION ALL SELECT unnest(tags), NULL, correct, chance FROM items),
    g AS (SELECT tag, category, count(*)::BIGINT AS n, count(*) FILTER (WHERE correct)::BIGINT AS k, round(avg(chance), 6) AS chance FROM r GROUP BY tag, category) SELECT tag, category, n, k, round(k / n, 6) AS accuracy, {_WILSON}, chance FROM g""",
)
def a17(spark, sf_dir):
    return evalstats.accuracy(_items(spark, sf_dir))


@register("a18_probe_summary", f"WITH {_ITEMS} SELECT category, count(*)::BIGINT AS n, count(*) FILTER (WHERE correct)::BIGINT AS correct, round(avg(correct::INT), 6) AS accuracy, round(avg(chance), 6) AS chance FROM items GROUP BY category")
def a18(spark, sf_dir):
    by = _items(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"), F.round(F.avg("chance"), 6).alias("chance"))
    return by


_sql(
    "a19_best_distractor",
    "SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS answer, (list_position(embedding[2:5], list_max(embedding[2:5])))::INTEGER AS best, embedding[1] > list_max(embedding[2:5]) AS correct FROM embeddings",
    "SELECT vec_id, round(CAST(embedding[0] AS DOUBLE), 6) AS answer, CAST(array_position(slice(embedding, 2, 4), array_max(slice(embedding, 2, 4))) AS INT) AS best, embedding[0] > array_max(slice(embedding, 2, 4)) AS correct FROM embeddings",
)


@register(
    "a20_bootstrap",
    f"""WITH p AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS k, {unit_sql(chr(39) + 'a' + chr(39), 'doc_id')} - {unit_sql(chr(39) + 'b' + chr(39), 'doc_id')} AS diff, n_chars::DOUBLE AS bytes FROM documents),
    draws AS (SELECT r.range AS replicate, (('0x' || substr(md5('1' || chr(31) || r.range::VARCHAR || chr(31) || p.k::VARCHAR), 1, 15))::BIGINT % (SELECT count(*) FROM p)) AS k FROM p, range(0, 200) r),
    d AS (SELECT replicate, sum(diff) / sum(bytes) AS delta FROM draws JOIN p USING (k) GROUP BY replicate)
    SELECT count(*)::BIGINT AS replicates, round(1e6 * quantile_cont(delta, 0.025), 4) AS low, round(1e6 * quantile_cont(delta, 0.975), 4) AS high, round(2 * least(avg((delta <= 0)::INT), avg((delta >= 0)::INT)), 6) AS p FROM d""",
)
def a20(spark, sf_dir):
    return _bootstrap(docs(spark, sf_dir))


def _bootstrap(d):
    rows = d.select("doc_id", (unit("a", F.col("doc_id")) - unit("b", F.col("doc_id"))).alias("diff"), F.col("n_chars").cast("double").alias("bytes"))
    pairs = staged(evalstats.numbered(rows, "doc_id").select("k", "diff", "bytes"), "pairs")
    r = evalstats.bootstrap(pairs, 200)
    sides = [F.avg((F.col("delta") <= 0).cast("int")), F.avg((F.col("delta") >= 0).cast("int"))]
    return r.agg(F.count("*").alias("replicates"), F.round(1e6 * F.percentile("delta", 0.025), 4).alias("low"), F.round(1e6 * F.percentile("delta", 0.975), 4).alias("high"), F.round(2 * F.least(*sides), 6).alias("p"))


_CONF = f"SELECT doc_id, {unit_sql(chr(39) + 'f' + chr(39), 'doc_id')} AS confidence, {unit_sql(chr(39) + 'c' + chr(39), 'doc_id')} < 0.6 AS correct FROM documents"


@register(
    "a22_calibration",
    f"WITH r AS ({_CONF}) SELECT least(floor(confidence * 10), 9)::BIGINT AS bin, count(*)::BIGINT AS n, round(avg(confidence), 6) AS confidence, round(avg(correct::INT), 6) AS accuracy, round(abs(avg(confidence) - avg(correct::INT)) * count(*) / (SELECT count(*) FROM r), 6) AS gap_share FROM r GROUP BY 1",
)
def a22(spark, sf_dir):
    rows = docs(spark, sf_dir).select(unit("f", F.col("doc_id")).alias("confidence"), (unit("c", F.col("doc_id")) < 0.6).alias("correct"))
    return evalstats.calibration(rows).select("bin", "n", *[F.round(c, 6).alias(c) for c in ("confidence", "accuracy", "gap_share")])


_sql("a23_mixture_mean", """
WITH s AS (SELECT source, avg(n_chars) AS loss FROM documents GROUP BY source), w AS (SELECT source, CASE WHEN source = 'src3' THEN 0.0 WHEN source = 'src1' THEN 3.0 ELSE 1.0 END AS weight FROM s)
SELECT round(avg(loss), 4) AS balanced, round(sum(loss * weight) / sum(weight), 4) AS mixed FROM s JOIN w USING (source)""")
_sql("a24_difficulty", """
WITH r AS (SELECT doc_id % 97 AS item, CAST(CASE WHEN length(text) % 3 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS ok, length(text) % 4 AS pick, n_chars FROM documents), g AS (SELECT item, avg(ok) AS share, count(DISTINCT pick) AS picks, avg(n_chars) AS margin FROM r GROUP BY item)
SELECT item, round(share, 6) AS share, CASE WHEN share >= 0.75 THEN 'easy' WHEN share <= 0.25 THEN 'hard' ELSE 'medium' END AS label, share = 0 AND picks = 1 AS flagged, round(margin, 4) AS margin FROM g""")
_sql("a25_index_base_vote", "SELECT lang, sum(CASE WHEN doc_id % 4 = n_chars % 4 THEN 1 ELSE 0 END) AS zero_based, sum(CASE WHEN doc_id % 4 + 1 = n_chars % 4 THEN 1 ELSE 0 END) AS one_based FROM documents GROUP BY lang",
     "SELECT lang, sum(CASE WHEN doc_id % 4 = n_chars % 4 THEN 1 ELSE 0 END) AS zero_based, sum(CASE WHEN doc_id % 4 + 1 = n_chars % 4 THEN 1 ELSE 0 END) AS one_based FROM documents GROUP BY lang")


@register("a26_estimates", f"WITH s AS (SELECT * FROM documents WHERE {unit_sql(chr(39) + '7' + chr(39), chr(39) + 'est' + chr(39), 'doc_id')} < 0.2), t AS (SELECT source, count(*) AS total FROM documents GROUP BY source) SELECT t.source, round(avg((s.n_chars >= 200)::INT) * any_value(total), 3) AS documents, round(avg(CASE WHEN s.n_chars >= 200 THEN s.n_chars ELSE 0 END) * any_value(total), 3) AS chars FROM t JOIN s USING (source) GROUP BY t.source")
def a26(spark, sf_dir):
    d = docs(spark, sf_dir)
    total = d.groupBy("source").agg(F.count("*").alias("total"))
    fit = F.col("n_chars") >= 200
    s = d.filter(unit("7", "est", F.col("doc_id")) < 0.2).groupBy("source").agg(F.avg(fit.cast("int")).alias("share"), F.avg(F.when(fit, F.col("n_chars")).otherwise(0)).alias("mean"))
    return s.join(total, "source").select("source", F.round(F.col("share") * F.col("total"), 3).alias("documents"), F.round(F.col("mean") * F.col("total"), 3).alias("chars"))


_SAMPLES = "SELECT user_id, (epoch_us(ts) // 1000000)::BIGINT AS s, event_id, value AS watts FROM events"
_ENERGY = f"""x AS (SELECT user_id, s, watts, s - lag(s) OVER w AS dt, lag(watts) OVER w AS before FROM ({_SAMPLES}) WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
e AS (SELECT user_id, s // 1800 * 1800 AS slot, sum((watts + before) / 2 * least(dt, 615) / 3600) AS watt_hours FROM x WHERE dt IS NOT NULL GROUP BY user_id, s // 1800 * 1800)"""


def _energy(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("s"), F.col("value").alias("watts"))
    return evalstats.energy_slots(e, "user_id", "s", "watts", 200.0, tie="event_id")


@register("a27_energy_slots", f"WITH {_ENERGY} SELECT user_id, slot, round(watt_hours + 1e-9, 4) AS watt_hours FROM e")
def a27(spark, sf_dir):
    return _energy(spark, sf_dir).select("user_id", "slot", F.round(F.col("watt_hours") + 1e-9, 4).alias("watt_hours"))


@register(
    "j16_tariff_interval",
    f"WITH {_ENERGY}, t AS (SELECT 1704067200 + range * 100000 AS a, 1704067200 + (range + 1) * 100000 AS z, 0.1::DOUBLE + 0.01::DOUBLE * range AS rate FROM range(0, 12)) SELECT e.user_id, e.slot, round(e.watt_hours * t.rate + 1e-9, 4) AS cost, t.rate IS NULL AS pending FROM e LEFT JOIN t ON e.slot >= t.a AND e.slot < t.z",
)
def j16(spark, sf_dir):
    e = _energy(spark, sf_dir)
    k = F.col("id")
    rates = spark.range(0, 12).select((1704067200 + k * 100000).alias("a"), (1704067200 + (k + 1) * 100000).alias("z"), (F.lit(0.1) + F.lit(0.01) * k).alias("rate"))
    priced = relational.interval_join(e, rates, "slot", "a", "z", 100000.0).select("user_id", "slot", "rate")
    return e.join(priced, ["user_id", "slot"], "left").select("user_id", "slot", F.round(F.col("watt_hours") * F.col("rate") + 1e-9, 4).alias("cost"), F.col("rate").isNull().alias("pending"))


@register(
    "a28_watermark_z",
    f"""WITH t AS (SELECT doc_id, unnest(ws) AS tok, generate_subscripts(ws, 1) AS k FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM documents)), p AS (SELECT DISTINCT doc_id, lag(tok) OVER (PARTITION BY doc_id ORDER BY k) AS prev, tok FROM t),
    g AS (SELECT doc_id, {unit_sql(chr(39) + 'wm' + chr(39), 'prev', 'tok')} < 0.5 AS green FROM p WHERE prev IS NOT NULL) SELECT doc_id, count(*) FILTER (WHERE green)::BIGINT AS green, count(*)::BIGINT AS scored, round((count(*) FILTER (WHERE green) - 0.5 * count(*)) / sqrt(count(*) * 0.25), 6) AS z FROM g GROUP BY doc_id""",
)
def a28(spark, sf_dir):
    """Pairs of neighbours, told apart and hashed inside their document."""
    from ..operators import tokens

    by = tokens.word_runs(docs(spark, sf_dir).select("doc_id", "text"), "text", 2, "\x1f", "wm\x1f").select("doc_id", F.col("low").alias("green"), F.col("distinct").alias("scored"))
    return by.withColumn("z", F.round((F.col("green") - 0.5 * F.col("scored")) / F.sqrt(F.col("scored") * 0.25), 6))


@register(
    "a29_loop_rate",
    """WITH t AS (SELECT doc_id, unnest(list_transform(range(0, len(ws) - 3), lambda i: array_to_string(ws[i + 1:i + 4], ' '))) AS gram, generate_subscripts(list_transform(range(0, len(ws) - 3), lambda i: i), 1) AS k FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS ws FROM documents) WHERE len(ws) >= 4),
    r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, gram ORDER BY k) > 1 AS again FROM t) SELECT doc_id, round(avg(again::INT), 6) AS rate, avg(again::INT) > 0.25 AS looping FROM r GROUP BY doc_id""",
)
def a29(spark, sf_dir):
    """A gram repeats as often as it occurs, less once: no order is needed to count that."""
    from ..operators import tokens

    by = tokens.word_runs(docs(spark, sf_dir).select("doc_id", "text"), "text", 4).withColumn("r", (F.col("runs") - F.col("distinct")) / F.col("runs"))
    return by.select("doc_id", F.round("r", 6).alias("rate"), (F.col("r") > 0.25).alias("looping"))


_sql("a30_band_effect", """
WITH r AS (SELECT floor(n_chars / 400) AS band, lang = 'en' AS label, ln(1 + n_chars) AS v FROM documents), g AS (SELECT band, label, count(*) AS n, avg(v) AS m FROM r GROUP BY band, label),
j AS (SELECT a.band, a.m - b.m AS d, CASE WHEN a.n < b.n THEN a.n ELSE b.n END AS w FROM g a JOIN g b ON a.band = b.band AND a.label AND NOT b.label WHERE a.n >= 20 AND b.n >= 20)
SELECT count(*) AS bands, round(sum(d * w) / sum(w), 6) AS effect FROM j""",
     """
WITH r AS (SELECT floor(n_chars / 400) AS band, lang = 'en' AS label, ln(1 + n_chars) AS v FROM documents), g AS (SELECT band, label, count(*) AS n, avg(v) AS m FROM r GROUP BY band, label),
j AS (SELECT a.band, a.m - b.m AS d, CASE WHEN a.n < b.n THEN a.n ELSE b.n END AS w FROM g a JOIN g b ON a.band = b.band AND a.label AND NOT b.label WHERE a.n >= 20 AND b.n >= 20)
SELECT count(*) AS bands, round(sum(d * w) / sum(w), 6) AS effect FROM j""")
_sql("a32_status_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority")
_sql("a33_median_gap", "SELECT user_id, median(gap) AS gap FROM (SELECT user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events) t WHERE gap IS NOT NULL GROUP BY user_id",
     "SELECT user_id, median(gap) AS gap FROM (SELECT user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events) t WHERE gap IS NOT NULL GROUP BY user_id")
_sql("w07_trailing_mean", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean5 FROM events")
_sql("w08_improvement", """
SELECT event_id, round((avg(value) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 2000 PRECEDING AND 1001 PRECEDING) - avg(value) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW))
  / (avg(event_id) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) - avg(event_id) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 2000 PRECEDING AND 1001 PRECEDING)) * 1000, 6) AS fall FROM events""")
_sql("w05_cumulative_share", "SELECT source, n, round(sum(n) OVER (ORDER BY n DESC, source) / sum(n) OVER (), 6) AS share FROM (SELECT source, sum(n_chars) AS n FROM documents GROUP BY source) t",
     "SELECT source, n, round(sum(n) OVER (ORDER BY n DESC, source) / sum(n) OVER (), 6) AS share FROM (SELECT source, sum(n_chars) AS n FROM documents GROUP BY source) t")
_sql("w13_session_delta", "SELECT event_id, event_id - lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS steps FROM events")
_sql("w14_gap_per_step", "SELECT event_id, round(value - 2.5, 6) AS gap FROM events WHERE event_type = 'click'")
_sql("s35_abandoned_tail", "SELECT event_id, step FROM (SELECT event_id, step, min(step) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM (SELECT user_id, event_id, event_id - CASE WHEN event_id % 100 = 99 THEN 40 ELSE 0 END AS step FROM events) a) b WHERE later IS NULL OR later > step")


@register(
    "a34_cosine_topk",
    """WITH p AS (SELECT a.vec_id AS query, b.vec_id AS vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
    SELECT query, vec_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS rn FROM p) WHERE rn <= 5""",
)
def a34(spark, sf_dir):
    from ..operators import vectors

    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.nearest(e.filter("vec_id % 50 = 0"), e, "vec_id", "embedding", 5)


@register("a34_row_norms", "SELECT label, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS norm FROM embeddings GROUP BY label")
def a34n(spark, sf_dir):
    from ..operators import vectors

    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.round(F.avg(vectors.norm(F.col("embedding"))), 6).alias("norm"))


_NUM = "CASE WHEN doc_id % 5 = 0 THEN 'integer' WHEN doc_id % 5 = 1 THEN 'date' ELSE 'decimal' END"


@register(
    "f24_numeric_grading",
    f"""WITH g AS (SELECT doc_id, {_NUM} AS kind, CASE WHEN doc_id % 5 = 1 THEN (doc_id % 12 + 1)::VARCHAR || '/3/2024' ELSE (n_chars % 50)::VARCHAR END AS answer, (n_chars % 50) * 0.95::DOUBLE AS low, (n_chars % 50) * 1.05::DOUBLE AS high,
      CASE WHEN doc_id % 5 = 1 THEN 'on ' || (doc_id % 10 + 1)::VARCHAR || '/3/2024' WHEN doc_id % 7 = 0 THEN 'none' ELSE 'it is ' || round((n_chars % 50) + (doc_id % 3) * 0.4, 1)::VARCHAR || ' units' END AS generated FROM documents),
    v AS (SELECT *, TRY_CAST(replace(regexp_extract(generated, '(-?\\d[\\d,]*\\.?\\d*)', 1), ',', '') AS DOUBLE) AS value FROM g)
    SELECT doc_id, CASE WHEN kind = 'date' THEN regexp_extract(generated, '(\\d{{1,2}}/\\d{{1,2}}/\\d{{2,4}})', 1) = answer WHEN value IS NULL THEN false WHEN kind = 'integer' THEN round_even(value, 0) = answer::DOUBLE ELSE value BETWEEN low AND high END AS correct FROM v""",
)
def f24(spark, sf_dir):
    i, n = F.col("doc_id"), F.col("n_chars")
    g = docs(spark, sf_dir).select(
        "doc_id",
        F.when(i % 5 == 0, "integer").when(i % 5 == 1, "date").otherwise("decimal").alias("kind"),
        F.when(i % 5 == 1, F.concat((i % 12 + 1).cast("string"), F.lit("/3/2024"))).otherwise((n % 50).cast("string")).alias("answer"),
        ((n % 50) * 0.95).alias("low"), ((n % 50) * 1.05).alias("high"),
        F.when(i % 5 == 1, F.concat(F.lit("on "), (i % 10 + 1).cast("string"), F.lit("/3/2024"))).when(i % 7 == 0, "none")
        .otherwise(F.concat(F.lit("it is "), F.round((n % 50) + (i % 3) * 0.4, 1).cast("string"), F.lit(" units"))).alias("generated"),
    )
    return g.select("doc_id", evalstats.numeric_correct(F.col("answer"), F.col("kind"), F.col("low"), F.col("high"), F.col("generated")).alias("correct"))


_GWAS = f"SELECT doc_id AS id, (doc_id % 22 + 1)::INTEGER AS chromosome, (doc_id * 7919 % 50000) * 1000 AS position, round(-log10(greatest({unit_sql(chr(39) + 'p' + chr(39), 'doc_id')}, 1e-9::DOUBLE)) * 4, 6) AS strength FROM documents"


def _gwas(spark, sf_dir):
    i = F.col("doc_id")
    return docs(spark, sf_dir).select(
        i.alias("id"), (i % 22 + 1).cast("int").alias("chromosome"), (i * 7919 % 50000 * 1000).alias("position"),
        F.round(-F.log10(F.greatest(unit("p", i), F.lit(1e-9))) * 4, 6).alias("strength"),
    )


@register("a16_gwas_counts", f"WITH g AS ({_GWAS}) SELECT chromosome, count(*)::BIGINT AS n, count(*) FILTER (WHERE strength > 7.30103)::BIGINT AS significant, round(median(least(strength, 300)), 6) AS median_strength FROM g GROUP BY chromosome")
def a16(spark, sf_dir):
    return _gwas(spark, sf_dir).groupBy("chromosome").agg(F.count("*").alias("n"), F.count_if(F.col("strength") > 7.30103).alias("significant"), F.round(F.median(F.least("strength", F.lit(300))), 6).alias("median_strength"))


@register(
    "j17_clump",
    f"""WITH RECURSIVE g AS ({_GWAS}), h AS (SELECT *, row_number() OVER (PARTITION BY chromosome ORDER BY strength DESC, position, id) AS k FROM g WHERE strength > 2),
    f AS (SELECT chromosome, 0::BIGINT AS k, []::BIGINT[] AS leads, NULL::BIGINT AS id, false AS lead FROM h GROUP BY chromosome UNION ALL
      SELECT h.chromosome, h.k, CASE WHEN len(list_filter(f.leads, lambda p: abs(p - h.position) <= 1000000)) = 0 THEN list_append(f.leads, h.position) ELSE f.leads END, h.id,
             len(list_filter(f.leads, lambda p: abs(p - h.position) <= 1000000)) = 0 FROM f JOIN h ON h.chromosome = f.chromosome AND h.k = f.k + 1)
    SELECT chromosome, id FROM f WHERE lead""",
)
def j17(spark, sf_dir):
    return evalstats.clumped(_gwas(spark, sf_dir).filter("strength > 2")).select("chromosome", "id")


_sql("j22_reference_results", "SELECT a.item_id, length(a.text) AS n, count(l.doc_id) AS models FROM benchmark a LEFT JOIN labels l ON l.doc_id % 40 = a.item_id GROUP BY a.item_id, length(a.text)")
