"""Queries of public projections, rebuilt documents and checked lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltide.operators import integrity, selection, visibility
from voltide.plans.market import t
from voltide.plans.registry import query


@query("SELECT c_custkey, c_mktsegment FROM customer")
def public_columns(spark, d):
    return visibility.public_view(t(spark, d, "customer"), ["c_custkey", "c_mktsegment"], {"cacctbal", "cname"})


@query("SELECT s_suppkey, s_nationkey, NULL::DOUBLE AS s_acctbal FROM supplier")
def nulled_columns(spark, d):
    return visibility.nulled(t(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), ["s_acctbal"])


@query("""SELECT event_id, '{"kind":"' || event_type || '","k":"' || json_extract_string(props, '$.k') || '"}' AS doc FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def json_rebuild(spark, d):
    k = F.get_json_object("props", "$.k")
    return t(spark, d, "events").where(k.isNotNull()).select("event_id", visibility.rebuilt_json(kind=F.col("event_type"), k=k).alias("doc"))


@query("""SELECT p_partkey, array_to_string([0.0::DOUBLE, p_size / 10::DOUBLE], ',') AS offsets FROM part""")
def json_offsets(spark, d):
    size = F.col("p_size") / F.lit(10.0)
    doc = F.to_json(F.struct(F.array(F.struct(F.lit(0.0).alias("offset"), F.lit(1.5).alias("value")), F.struct(size.alias("offset"), F.lit(2.5).alias("value"))).alias("nodes")))
    offsets = F.transform(visibility.node_offsets(doc), lambda x: x.cast("string"))
    return t(spark, d, "part").select("p_partkey", F.array_join(offsets, ",").alias("offsets"))


@query("""SELECT target, count(*) AS n FROM (SELECT list_element(['a', 'b', 'c'], ((row_number() OVER (PARTITION BY s_nationkey ORDER BY sha256('g17|3|' || s_suppkey), s_suppkey) - 1) % 3 + 1)::INTEGER) AS target FROM supplier) GROUP BY target""")
def allocation_counts(spark, d):
    return selection.allocate_round_robin(t(spark, d, "supplier"), ["a", "b", "c"], "g17", 3, "s_suppkey", "s_nationkey").groupBy("target").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7")
def checked_lookup(spark, d):
    """A lookup join whose right side must have each key once and whose left
    side must find a match; both are gates."""
    customers = t(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_name", "c_nationkey")
    orders = t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    integrity.run_gates({"repeated_customer": integrity.repeated_keys(customers, ["key"]), "orders_without_customer": integrity.orphans(orders, customers, ["key"])})
    return orders.join(customers, "key").where("c_nationkey = 7").select("o_orderkey", "c_name")


@query("SELECT c_custkey, list_sort(list_filter(['a', 'b', 'c'], lambda x: (x = 'a' AND c_nationkey <> 3) OR (x = 'b' AND c_custkey % 2 <> 1) OR (x = 'c' AND c_acctbal > 0)))[1] AS first_axis, len(list_filter(['a', 'b', 'c'], lambda x: (x = 'a' AND c_nationkey <> 3) OR (x = 'b' AND c_custkey % 2 <> 1) OR (x = 'c' AND c_acctbal > 0)))::INTEGER AS n_axes FROM customer")
def coordinate_difference(spark, d):
    make = lambda a, b, c: F.create_map(F.lit("a"), a, F.lit("b"), b, F.lit("c"), c)
    own = make(F.col("c_nationkey").cast("long"), F.col("c_custkey") % 2, F.when(F.col("c_acctbal") > 0, 1).otherwise(0).cast("long"))
    other = make(F.lit(3).cast("long"), F.lit(1).cast("long"), F.lit(0).cast("long"))
    diff = selection.coordinate_difference(own, other)
    return t(spark, d, "customer").select("c_custkey", F.try_element_at(diff, F.lit(1)).alias("first_axis"), F.size(diff).alias("n_axes"))
