"""The relational base over the star schema: joins, grouping sets, windows, sets, JSON, arrays, sketches."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..operators import relational
from .catalog import register
from .common import table


def _sql(name: str, sql: str, spark_sql: str | None = None, *tables: str) -> None:
    """A query given as SQL to both engines (or in each one's words), so that Catalyst plans it."""
    names = tables or tuple(t for t in TABLES if f" {t}" in sql.replace("\n", " "))

    @register(name, sql)
    def run(spark, sf_dir):
        for t in names:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(spark_sql or sql)


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
R = "round({}, 2)"

_sql("j24_pricing_summary", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
  round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 4) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
_sql("j24_inner_revenue_by_nation", """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer
JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""")
_sql("j24_left_outer_counts", """
SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) t GROUP BY c_count""")
_sql("j24_full_outer", """
SELECT coalesce(s.n, c.n) AS nationkey, coalesce(s.k, 0) AS suppliers, coalesce(c.k, 0) AS customers
FROM (SELECT s_nationkey AS n, count(*) AS k FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) s
FULL OUTER JOIN (SELECT c_nationkey AS n, count(*) AS k FROM customer WHERE c_acctbal > 9000 GROUP BY c_nationkey) c ON s.n = c.n""")
_sql("j24_semi_exists", """
SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY o_orderpriority""")
_sql("j24_anti_not_exists", """
SELECT c_mktsegment, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) GROUP BY c_mktsegment""")


@register(
    "j24_theta_band",
    """
SELECT p.p_brand, count(*) AS pairs FROM part p JOIN part q ON p.p_brand = q.p_brand AND p.p_partkey < q.p_partkey AND q.p_size BETWEEN p.p_size AND p.p_size + 2 GROUP BY p.p_brand""",
)
def j24_theta_band(spark, sf_dir):
    return relational.band_pair_counts(table(spark, sf_dir, "part"), "p_brand", "p_partkey", "p_size", 2)


_sql("j24_large_orders", """
SELECT c_name, c_custkey, o_orderkey, o_totalprice, sum(l_quantity) AS qty FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) GROUP BY c_name, c_custkey, o_orderkey, o_totalprice""")
_sql("j24_scalar_subquery", """
SELECT p_partkey, p_brand, p_retailprice FROM part p WHERE p_retailprice > (SELECT 1.0 * avg(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)""")
_sql("j24_lateral_top", """
SELECT c.c_custkey, t.o_orderkey, t.o_totalprice FROM customer c, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t""")
_sql("a37_cube", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag) + 2 * grouping(l_linestatus) AS level, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
_sql("a37_rollup", "SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
_sql("a37_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
_sql("a38_distinct_aggregates", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, sum(DISTINCT l_linenumber) AS line_numbers FROM lineitem GROUP BY l_returnflag")
_sql("a35_mode", "SELECT source, k AS mode_words FROM (SELECT source, k, row_number() OVER (PARTITION BY source ORDER BY n DESC, k) AS rn FROM (SELECT source, length(text) - length(replace(text, chr(10), '')) AS k, count(*) AS n FROM documents GROUP BY source, length(text) - length(replace(text, chr(10), ''))) a) b WHERE rn = 1")
_sql("w15_ranking", """
SELECT o_orderkey, rank() OVER w AS rank_, dense_rank() OVER w AS dense_, CAST(ntile(4) OVER v AS BIGINT) AS quarter, round(percent_rank() OVER w, 6) AS pct, round(cume_dist() OVER w, 6) AS cume
FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate), v AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey)""".replace("rank() OVER w AS rank_, dense_rank() OVER w AS dense_", "CAST(rank() OVER w AS BIGINT) AS rank_, CAST(dense_rank() OVER w AS BIGINT) AS dense_"))
_sql("w15_frames", """
SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS last3,
  count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS near,
  lead(event_type, 1, 'none') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type,
  nth_value(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_id FROM events""")
_sql("u01_union_by_name", "SELECT doc_id AS id, 'd' AS kind FROM documents UNION ALL SELECT item_id AS id, 'b' AS kind FROM benchmark")
_sql("u02_intersect", "SELECT s_nationkey AS n FROM supplier INTERSECT SELECT c_nationkey AS n FROM customer WHERE c_acctbal > 9500")
_sql("u03_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
_sql("u05_intersect_all", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT ALL SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'")
_sql("u05_except_all", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT ALL SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'")
_sql("s04_projected_scan", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01' AND l_quantity < 5")
_sql("fn_string", "SELECT o_orderkey, lower(substring(o_orderpriority, 3, 6)) AS a, concat(o_orderstatus, '-', lpad(CAST(o_custkey AS VARCHAR), 8, '0')) AS b, replace(o_orderpriority, 'URGENT', 'U') AS c, strpos(o_orderpriority, 'I') AS d FROM orders",
     "SELECT o_orderkey, lower(substring(o_orderpriority, 3, 6)) AS a, concat(o_orderstatus, '-', lpad(CAST(o_custkey AS STRING), 8, '0')) AS b, replace(o_orderpriority, 'URGENT', 'U') AS c, CAST(locate('I', o_orderpriority) AS BIGINT) AS d FROM orders")
_sql("fn_math", "SELECT l_orderkey, l_linenumber, round(sqrt(l_extendedprice), 6) AS a, round(ln(1 + l_quantity), 6) AS b, floor(l_extendedprice / 7) AS c, round(power(l_discount, 2), 6) AS d, CAST(l_partkey % 7 AS BIGINT) AS e, round(log10(l_extendedprice), 6) AS f FROM lineitem",
     "SELECT l_orderkey, l_linenumber, round(sqrt(l_extendedprice), 6) AS a, round(ln(1 + l_quantity), 6) AS b, CAST(floor(l_extendedprice / 7) AS DOUBLE) AS c, round(power(l_discount, 2), 6) AS d, CAST(l_partkey % 7 AS BIGINT) AS e, round(log10(l_extendedprice), 6) AS f FROM lineitem")
_sql("fn_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, strftime(o_orderdate + INTERVAL 29 DAY, '%Y-%m-%d') AS window_end, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start FROM orders",
     "SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM-dd') AS day, year(o_orderdate) AS y, month(o_orderdate) AS m, date_format(o_orderdate + INTERVAL 29 DAY, 'yyyy-MM-dd') AS window_end, date_format(date_trunc('month', o_orderdate), 'yyyy-MM-dd') AS month_start FROM orders")
_sql("fn_json", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS ok FROM events", "SELECT event_id, get_json_object(props, '$.k') AS k, try_parse_json(props) IS NOT NULL AS ok FROM events")
_sql("fn_array", "SELECT vec_id, len(embedding)::INTEGER AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS s, round(list_max(embedding)::DOUBLE, 6) AS m, len(list_filter(embedding, lambda x: x > 0))::INTEGER AS pos FROM embeddings",
     "SELECT vec_id, size(embedding) AS n, round(aggregate(embedding, 0D, (a, x) -> a + x), 6) AS s, round(CAST(array_max(embedding) AS DOUBLE), 6) AS m, size(filter(embedding, x -> x > 0)) AS pos FROM embeddings")
_sql("fn_map", "SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS f, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS o FROM orders GROUP BY o_custkey",
     "SELECT o_custkey, coalesce(m['F'], 0L) AS f, coalesce(m['O'], 0L) AS o FROM (SELECT o_custkey, map_from_entries(collect_list(struct(o_orderstatus, n))) AS m FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus) GROUP BY o_custkey)")
_sql("u_pivot", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders GROUP BY o_orderpriority",
     "SELECT o_orderpriority, coalesce(F, 0L) AS f, coalesce(O, 0L) AS o FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F', 'O'))")
_sql("u_unpivot", "SELECT s_suppkey, 'nation' AS name, s_nationkey::DOUBLE AS value FROM supplier UNION ALL SELECT s_suppkey, 'balance', s_acctbal FROM supplier",
     "SELECT s_suppkey, name, value FROM (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS nation, s_acctbal AS balance FROM supplier) UNPIVOT (value FOR name IN (nation, balance))")
_sql("t_topk_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
_sql("cte_recursive", "WITH RECURSIVE t(n, total) AS (SELECT 1::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, total + n + 1 FROM t WHERE n < 20) SELECT t.n, t.total, count(r_regionkey) AS regions FROM t JOIN region ON r_regionkey < t.n GROUP BY t.n, t.total",
     "WITH RECURSIVE t(n, total) AS (SELECT 1L, 1L UNION ALL SELECT n + 1, total + n + 1 FROM t WHERE n < 20) SELECT t.n, t.total, count(r_regionkey) AS regions FROM t JOIN region ON r_regionkey < t.n GROUP BY t.n, t.total")


@register(
    "j24_asof",
    "SELECT e.event_id, p.event_id AS purchase_id FROM (SELECT * FROM events WHERE event_type <> 'purchase') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts >= p.ts",
)
def j24_asof(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    bought = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("purchase_id"))
    others = e.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    return relational.asof(others, bought, ["user_id"], "ts", "ts", ["purchase_id"]).select("event_id", "purchase_id")


@register(
    "j24_interval",
    "SELECT o.o_orderkey, b.s_suppkey FROM orders o JOIN (SELECT s_suppkey, s_suppkey * 4000.0 AS lo, s_suppkey * 4000.0 + 5000.0 AS hi FROM supplier) b ON o.o_totalprice >= b.lo AND o.o_totalprice < b.hi",
)
def j24_interval(spark, sf_dir):
    spans = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 4000.0).alias("lo"), (F.col("s_suppkey") * 4000.0 + 5000.0).alias("hi"))
    points = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return relational.interval_join(points, spans, "o_totalprice", "lo", "hi", 5000.0).select("o_orderkey", "s_suppkey")


@register("a_salted_sum", "SELECT event_type, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def a_salted(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return relational.salted_sum(e, ["event_type"], F.col("value")).withColumn("total", F.round("total", 2))


@register(
    "a36_approximate",
    "SELECT event_type, true AS distinct_close, true AS median_close FROM events GROUP BY event_type",
)
def a36(spark, sf_dir):
    """Sketches against what they estimate: within five per cent."""
    e = table(spark, sf_dir, "events")
    by = e.groupBy("event_type").agg(
        F.approx_count_distinct("user_id", 0.02).alias("a"), F.count_distinct("user_id").alias("b"),
        F.percentile_approx("value", 0.5, 10000).alias("c"), F.percentile("value", 0.5).alias("d"),
    )
    close = lambda x, y: F.abs(F.col(x) - F.col(y)) <= 0.05 * F.abs(F.col(y)) + 1e-9
    return by.select("event_type", close("a", "b").alias("distinct_close"), close("c", "d").alias("median_close"))


@register("a05_first_example", "SELECT event_type, arg_min(event_id, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS first_id FROM events GROUP BY event_type")
def a05(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_id"))


@register(
    "w06_newest_per_key",
    "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
)
def w06(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    newest = e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("x"))
    return newest.select("user_id", "x.event_id", "x.event_type")
