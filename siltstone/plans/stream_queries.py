"""Streams run over all files there are; their SQL is that of the same tables in one batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import events as st
from .catalog import register


def _events(spark, sf_dir):
    return st.read_events(spark, f"{sf_dir}/events.parquet")


def _ntz(column: str):
    return F.col(column).cast("timestamp_ntz").alias(column)


@register("st02_dedup_watermark", "SELECT DISTINCT user_id, event_type FROM events")
def st02(spark, sf_dir):
    return st.drained(st.deduplicated(_events(spark, sf_dir), "user_id", "event_type", late="400 days")).select("user_id", "event_type")


@register("st04_tumbling_price", """WITH s AS (SELECT time_bucket(INTERVAL '30 minutes', ts) AS start, event_type, sum(value) AS total FROM events GROUP BY ALL)
SELECT start, event_type, round(total * p.price, 4) AS cost, p.price IS NULL AS pending FROM s LEFT JOIN (VALUES (TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-10', 0.5), (TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-20', 0.25)) p(a, z, price) ON start >= a AND start < z""")
def st04(spark, sf_dir):
    slots = st.drained(st.tumbling(_events(spark, sf_dir), "30 minutes", F.col("value")), "update", st.latest_of("start", "event_type"))
    prices = spark.sql("SELECT * FROM VALUES (TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-10', 0.5D), (TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-20', 0.25D) AS p(`from`, `to`, price)")
    return st.priced(slots, prices).select(_ntz("start"), "event_type", F.round("cost", 4).alias("cost"), "pending")


@register("st05_first_n_state", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn <= 3")
def st05(spark, sf_dir):
    return st.drained(st.first_n(_events(spark, sf_dir), "user_id", 3), "update", st.last_of("user_id"))


@register("st06_stream_dedup", "SELECT DISTINCT user_id FROM events")
def st06(spark, sf_dir):
    return st.drained(_events(spark, sf_dir).select("user_id").dropDuplicates(["user_id"]))


@register("st10_sessions", """WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '6 hours', true) AS new FROM events),
n AS (SELECT user_id, ts, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM n GROUP BY user_id, k""")
def st10(spark, sf_dir):
    # a session that may go on is put out by the update that closes the input; complete mode holds all of them
    out = st.drained(st.sessions(_events(spark, sf_dir), "6 hours"), "complete", lambda o: o.join(o.agg(F.max("batch").alias("last")), F.col("batch") == F.col("last")))
    return out.select("user_id", _ntz("start"), "n")


@register("st11_sliding", """WITH w AS (SELECT unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS start FROM events) SELECT start, count(*)::BIGINT AS n FROM w GROUP BY start""")
def st11(spark, sf_dir):
    return st.drained(st.sliding(_events(spark, sf_dir), "2 hours", "1 hour"), "update", st.latest_of("start")).select(_ntz("start"), "n")


@register("st03_date_windows", "SELECT time_bucket(INTERVAL '30 days', ts, TIMESTAMP '2024-01-01') AS start, count(*)::BIGINT AS n FROM events GROUP BY 1")
def st03(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    first = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    k = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(first.cast("timestamp"))) / (30 * 86400))
    return e.groupBy(k.alias("k")).agg(F.count("*").alias("n")).select((first + F.make_dt_interval(F.col("k") * 30)).alias("start"), "n")
