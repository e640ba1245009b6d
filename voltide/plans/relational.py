"""Relational queries of the endpoint's surface, with oracles.

Where both engines read a text alike it is given once; Spark's optimizer plans
it, so filters and columns still reach the scans.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voltide.plans.market import t
from voltide.plans.registry import query

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


def text_query(name: str, sql: str, spark_text: str | None = None) -> None:
    """Register one SQL text; ``spark_text`` where Spark spells it otherwise."""
    use = spark_text or sql

    def run(spark, d):
        session = spark
        for n in TABLES:
            if n in use:
                t(session, d, n).createOrReplaceTempView(n)
        return session.sql(use)

    run.__doc__ = f"The SQL text of {name}."
    query(sql, name)(run)


# Joins
text_query("join_using", "SELECT c_nationkey, count(*) AS n FROM customer JOIN (SELECT s_nationkey AS c_nationkey, s_suppkey FROM supplier) s USING (c_nationkey) GROUP BY c_nationkey")
text_query("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'O' GROUP BY c_custkey")
text_query("join_right", "SELECT p_partkey, count(l_orderkey) AS n FROM lineitem RIGHT JOIN part ON l_partkey = p_partkey GROUP BY p_partkey")
text_query("join_full", "SELECT n_nationkey, s_suppkey FROM nation FULL JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000")
text_query("join_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
text_query("join_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
text_query("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE r_regionkey < 2 AND n_nationkey < 5")
text_query("join_theta", "SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
text_query("join_natural", "SELECT n_nationkey, n_name, r_name FROM (SELECT n_nationkey, n_name, n_regionkey AS r_regionkey FROM nation) n NATURAL JOIN region")
text_query("join_lateral", "SELECT n_nationkey, s_suppkey FROM nation, LATERAL (SELECT s_suppkey FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000) s")
text_query("in_list_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) AND o_totalprice BETWEEN 50000 AND 150000")
text_query("scalar_subquery", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
text_query("correlated_subquery", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer")
text_query("computed_key_join", "SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders JOIN (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_linenumber = 1) s ON CAST(o_orderdate AS DATE) = s.d GROUP BY CAST(o_orderdate AS DATE)")

# Filters and projections
text_query("like_filters", "SELECT p_partkey, p_name LIKE '%a%' AS has_a, p_type FROM part WHERE p_type LIKE '%E%' AND p_brand NOT LIKE '%5'")
text_query("ilike_filter", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment ILIKE 'b%'")
text_query("regex_filter", "SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '[13]$')", "SELECT p_partkey, p_brand FROM part WHERE p_brand RLIKE '[13]$'")
text_query("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS size, o_orderstatus = 'F' AS filled FROM orders")
text_query("null_logic", "SELECT s_suppkey, nullif(s_nationkey, 3) AS k, nullif(s_nationkey, 3) IS NULL AS missing, coalesce(nullif(s_nationkey, 3), -1) AS filled FROM supplier WHERE s_acctbal IS NOT NULL")
text_query("values_source", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (2, NULL)) AS v(k, x)")
text_query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")

# Aggregates
text_query("agg_basic", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_partkey) AS parts, min(l_shipdate) AS first_ship, max(l_quantity) AS top, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue, round(avg(l_discount), 6) AS discount FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")
text_query("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
text_query("agg_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS filled, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS open FROM orders GROUP BY o_orderpriority")
text_query("agg_bool", "SELECT o_custkey, bool_and(o_totalprice > 1000) AS every_big, bool_or(o_orderstatus = 'P') AS some_p FROM orders GROUP BY o_custkey")
text_query("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS INTEGER) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS INT) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
text_query("agg_rollup", "SELECT n_regionkey, n_nationkey, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)")
text_query("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
text_query("agg_stats", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 5) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS r, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(covar_pop(l_quantity, l_discount), 6) AS cov FROM lineitem GROUP BY l_returnflag")
text_query("agg_quantiles", "SELECT l_returnflag, median(l_quantity) AS med, quantile_cont(l_extendedprice, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, median(l_quantity) AS med, percentile_cont(0.9) WITHIN GROUP (ORDER BY l_extendedprice) AS p90 FROM lineitem GROUP BY l_returnflag")
text_query("agg_arg_extremes", "SELECT o_custkey, arg_max(o_orderkey, o_totalprice * 1000000 + o_orderkey) AS best FROM orders GROUP BY o_custkey", "SELECT o_custkey, max_by(o_orderkey, o_totalprice * 1000000 + o_orderkey) AS best FROM orders GROUP BY o_custkey")
text_query("agg_lists", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, len(list(n_name)) AS n FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names, cast(size(collect_list(n_name)) as bigint) AS n FROM nation GROUP BY n_regionkey")
text_query("agg_bits", "SELECT l_returnflag, bit_and(l_linenumber) AS a, bit_or(l_linenumber) AS o, bit_xor(l_linenumber) AS x FROM lineitem GROUP BY l_returnflag")
text_query("agg_distinct_count", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")


@query("SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS f, max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS o FROM orders GROUP BY o_custkey")
def pivot_sides(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O"]).agg(F.max("o_totalprice")).select("o_custkey", F.col("F").alias("f"), F.col("O").alias("o"))


@query("SELECT l_returnflag, round(sum(CAST(l_extendedprice AS DECIMAL(28,10)))::DOUBLE, 4) AS sum_l_extendedprice FROM lineitem GROUP BY l_returnflag")
def exact_sum(spark, d):
    from voltide.operators.integrity import exact_sum as exact

    out = exact(t(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return out.withColumn("sum_l_extendedprice", F.round("sum_l_extendedprice", 4))


# Windows
_W = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
text_query("window_rank", f"SELECT o_orderkey, row_number() {_W} AS rn, rank() {_W} AS rk, dense_rank() {_W} AS dr, ntile(4) {_W} AS quarter FROM orders".replace("row_number() " + _W, f"CAST(row_number() {_W} AS INTEGER)").replace(" rank() " + _W, f" CAST(rank() {_W} AS INTEGER)").replace("dense_rank() " + _W, f"CAST(dense_rank() {_W} AS INTEGER)").replace("ntile(4) " + _W, f"CAST(ntile(4) {_W} AS INTEGER)"))
text_query("window_offsets", f"SELECT o_orderkey, lag(o_totalprice) {_W} AS before, lead(o_totalprice, 2, -1) {_W} AS later, first_value(o_orderkey) {_W} AS first_key, nth_value(o_orderkey, 2) {_W} AS second_key FROM orders")
text_query("window_frames", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS rolling, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS near FROM orders")
text_query("window_shares", f"SELECT o_orderkey, round(percent_rank() {_W}, 8) AS pr, round(cume_dist() {_W}, 8) AS cd, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 8) AS share FROM orders")
text_query("window_qualify", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r FROM orders) WHERE r <= 1")
def top_with_ties(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))
    return t(spark, d, "orders").withColumn("r", F.rank().over(w)).where("r <= 1").select("o_custkey", "o_orderkey")


# Order and limits: a limit here is the feature
text_query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
text_query("offset_page", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 20")
text_query("nulls_order", "SELECT k, x FROM (SELECT s_suppkey AS k, nullif(s_nationkey, 3) AS x FROM supplier) ORDER BY x NULLS LAST, k LIMIT 15")
text_query("latest_version", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")

# Sets, WITH and recursion
text_query("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
text_query("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
text_query("intersect_rows", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
text_query("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
text_query("except_rows", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000")
text_query("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
text_query("chained_with", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), top AS (SELECT o_custkey FROM big WHERE s > 1000000) SELECT c_nationkey, count(*) AS n FROM customer JOIN top ON c_custkey = o_custkey GROUP BY c_nationkey")
text_query("recursive_cte", "WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 15) SELECT n, f FROM r")

# The stream table, in batch form; streaming/ has the same windows on streams
text_query("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL", "SELECT window.start AS window_start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY window(ts, '1 hour'), event_type")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, sid""")
def event_sessions(spark, d):
    s = t(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("session_start"), "n")
