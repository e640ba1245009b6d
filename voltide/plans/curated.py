"""Curated market queries, gates and domain operators, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltide.functions import curves
from voltide.operators import calendar, chain, dependence, integrity, pricing, selection
from voltide.plans.market import OPTIONS_SQL, options, price_sql, t
from voltide.plans.registry import query
from voltide.sources import tables

_O = "WITH " + OPTIONS_SQL


@query()
def market_greeks(spark, d):
    """Price each row, read the price back as a quote, and return the implied
    volatility and Greeks at its root as eight-place texts."""
    args = [F.col(x) for x in ("call_put", "spot", "strike", "tau", "rate", "yield")]
    o = options(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "date", *args, "sigma")
    priced = pricing.with_greeks(o, *args, F.col("sigma")).select(*o.columns, F.col("price").cast("decimal(24,8)").cast("double").alias("observed")).drop("sigma")
    solved = pricing.with_implied_volatility(priced, *args, F.col("observed"), greeks=True, text=True)
    return solved.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "date", "iv_status", "implied_volatility", "delta", "gamma", "vega_1volpt", "theta_1calendar_day", "rho_1pct", "iterations")


@query(f"{_O} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({price_sql()}, 5) + 0.0::DOUBLE AS price FROM opt")
def bsm_price_sql(spark, d):
    args = [F.col(x) for x in ("spot", "strike", "tau", "rate", "yield", "sigma")]
    return options(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.round(pricing.price_column(F.col("call_put") == "call", *args), 5) + F.lit(0.0)).alias("price"))


@query(f"""{_O}, obs AS (SELECT *, {price_sql()} AS observed FROM opt),
solved AS (SELECT *, list_reduce(list_prepend({{'lo': 1e-6::DOUBLE, 'hi': 5::DOUBLE}}, [{{'lo': 0::DOUBLE, 'hi': 0::DOUBLE}} for i in range(80)]), lambda a, i:
  CASE WHEN {price_sql("((a.lo + a.hi) / 2)")} < observed THEN {{'lo': (a.lo + a.hi) / 2, 'hi': a.hi}} ELSE {{'lo': a.lo, 'hi': (a.lo + a.hi) / 2}} END) AS s FROM obs)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({price_sql("((s.lo + s.hi) / 2)")} + 0.0000123::DOUBLE, 4) + 0.0::DOUBLE AS price_at_root FROM solved""")
def implied_vol_80(spark, d):
    """Eighty bisections of each row; compared by the price at the root, which
    is well conditioned where the root itself is not."""
    args = [F.col(x) for x in ("spot", "strike", "tau", "rate", "yield")]
    call = F.col("call_put") == "call"
    obs = options(spark, d).withColumn("observed", pricing.price_column(call, *args, F.col("sigma")))
    solved = pricing.with_bisection_root(obs, F.col("call_put"), *args, F.col("observed"))
    # Shifted off the middle between two fourth places, where exact prices may lie.
    at_root = F.round(pricing.price_column(call, *args, F.col("root")) + 0.0000123, 4) + F.lit(0.0)
    return solved.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", at_root.alias("price_at_root"))


@query(f"""{_O}, b AS (SELECT *, spot * exp(-yield * tau) AS f, strike * exp(-rate * tau) AS c FROM opt),
x AS (SELECT *, greatest(CASE WHEN call_put = 'call' THEN f - c ELSE c - f END, 0) AS lower, CASE WHEN call_put = 'call' THEN f ELSE c END AS upper, abs(spot - strike) AS quote FROM b)
SELECT call_put, CASE WHEN quote >= lower AND quote < upper THEN 'inside' ELSE 'outside' END AS verdict, count(*) AS n, round(sum(lower), 2) AS lower_sum FROM x GROUP BY ALL""")
def price_bounds(spark, d):
    args = [F.col(x) for x in ("call_put", "spot", "strike", "tau", "rate", "yield")]
    lower, upper = pricing.price_bounds(*args)
    x = options(spark, d).withColumns({"lower": lower, "upper": upper, "quote": F.abs(F.col("spot") - F.col("strike"))})
    inside = (F.col("quote") >= F.col("lower")) & (F.col("quote") < F.col("upper"))
    return x.groupBy("call_put", F.when(inside, "inside").otherwise("outside").alias("verdict")).agg(F.count("*").alias("n"), F.round(F.sum("lower"), 2).alias("lower_sum"))


@query("""WITH g AS (SELECT p_partkey, CAST(p_retailprice AS DECIMAL(24,8)) AS spot, m FROM part, (SELECT unnest([0.8, 0.9, 1.0, 1.1, 1.2])::DECIMAL(10,4) AS m))
SELECT p_partkey, m::DOUBLE AS moneyness, round_even((spot * m) / 0.5, 0)::DOUBLE * 0.5 AS strike, e.days AS expiry_days, s AS call_put
FROM g, (SELECT unnest([30, 90, 180])::INTEGER AS days) e, (SELECT unnest(['call', 'put']) AS s) WHERE m BETWEEN 0.85 AND 1.15 AND e.days <= 90""")
def chain_grid(spark, d):
    """Expiry, strike and side of each listing, then the liquidity band."""
    listing = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("underlying_id"), "p_partkey", F.lit("2026-01-02").cast("date").alias("listing_date"), F.col("p_retailprice").alias("spot"))
    grid = chain.liquid(chain.candidate_grid(listing, [30, 90, 180], ["0.8", "0.9", "1.0", "1.1", "1.2"]), 90)
    return grid.select("p_partkey", F.col("moneyness").cast("double").alias("moneyness"), F.col("strike").cast("double").alias("strike"), "expiry_days", "call_put")


@query(f"""{_O}, q AS (SELECT DISTINCT l_partkey AS underlying_id, l_linenumber AS expiry, strike, spot * exp((rate - yield) * tau) AS forward FROM opt),
e AS (SELECT *, dense_rank() OVER (PARTITION BY underlying_id ORDER BY expiry) AS er FROM q),
k AS (SELECT *, dense_rank() OVER (PARTITION BY underlying_id, expiry ORDER BY abs(ln(strike / forward)), strike) AS kr FROM e WHERE er <= 2)
SELECT underlying_id, expiry, round(strike, 6) AS strike, round(forward, 6) AS forward FROM k WHERE kr <= 5""")
def near_atm_grid(spark, d):
    """The earliest expiries of each underlying, and in each the strikes nearest
    to the forward."""
    forward = F.col("spot") * F.exp((F.col("rate") - F.col("yield")) * F.col("tau"))
    q = options(spark, d).select(F.col("l_partkey").alias("underlying_id"), F.col("l_linenumber").alias("expiry"), "strike", forward.alias("forward")).distinct()
    return chain.nearest_to_forward(q).select("underlying_id", "expiry", F.round("strike", 6).alias("strike"), F.round("forward", 6).alias("forward"))


@query("""SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS date, date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS days,
  round(date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') / 365::DOUBLE, 8) AS tau, round(ln(o_totalprice / 1000), 8) AS log_price, round(o_totalprice / nullif(c_acctbal, 0), 4) AS ratio
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 0""")
def spot_moneyness(spark, d):
    o, c = t(spark, d, "orders"), t(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    date = F.to_date("o_orderdate")
    days = F.datediff(F.lit("1999-01-01").cast("date"), date).cast("long")
    return o.where("o_totalprice > 0").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", date.alias("date"), days.alias("days"), F.round(days / F.lit(365.0), 8).alias("tau"), F.round(F.ln(F.col("o_totalprice") / 1000), 8).alias("log_price"), F.round(F.col("o_totalprice") / F.nullif(F.col("c_acctbal"), F.lit(0.0)), 4).alias("ratio"))


@query("""WITH s AS (SELECT o_custkey, count(*) AS n_orders, count(DISTINCT CAST(o_orderdate AS DATE)) AS n_dates, min(CAST(o_orderdate AS DATE)) AS first_date, max(CAST(o_orderdate AS DATE)) AS last_date,
  count(*) FILTER (WHERE o_orderstatus = 'F') AS n_filled FROM orders GROUP BY o_custkey)
SELECT c_custkey, c_name, n_orders, n_dates, first_date, last_date, n_filled, (SELECT count(*) FROM supplier WHERE s_nationkey = c_nationkey) AS n_suppliers
FROM customer LEFT JOIN s ON o_custkey = c_custkey""")
def snapshot_summary(spark, d):
    """Per-entity statistics with a left join and a decorrelated count."""
    date = F.to_date("o_orderdate")
    s = t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.countDistinct(date).alias("n_dates"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count_if(F.col("o_orderstatus") == "F").alias("n_filled"))
    per_nation = t(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    c = t(spark, d, "customer").join(s, F.col("o_custkey") == F.col("c_custkey"), "left").join(per_nation, F.col("s_nationkey") == F.col("c_nationkey"), "left")
    return c.select("c_custkey", "c_name", "n_orders", "n_dates", "first_date", "last_date", "n_filled", F.coalesce("n", F.lit(0)).alias("n_suppliers"))


@query("""SELECT p_brand, p_type, count(*) AS n, count(DISTINCT p_size) AS n_sizes, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY p_brand, p_type""")
def chain_spec_stats(spark, d):
    return t(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.countDistinct("p_size").alias("n_sizes"), F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS date, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderdate BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1995-12-31' AND o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def pricing_context(spark, d):
    """Filters reach the scan; the small sides are joined by size at run time."""
    o = t(spark, d, "orders").where(F.col("o_orderdate").between(F.lit("1994-01-01").cast("timestamp"), F.lit("1995-12-31").cast("timestamp")) & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    j = o.join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("o_orderkey", "o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("date"), "n_name", "r_name")


@query("""SELECT CAST(l_shipdate AS DATE) AS date, l_partkey % 50 AS underlying, count(*) AS n, round(sum(l_quantity), 2) AS volume, min(l_extendedprice / l_quantity) AS low, max(l_extendedprice / l_quantity) AS high FROM lineitem GROUP BY ALL""")
def underlying_time_series(spark, d):
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return t(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("date"), (F.col("l_partkey") % 50).alias("underlying")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("volume"), F.min(price).alias("low"), F.max(price).alias("high"))


@query("""SELECT 'orphan_customer' AS gate, count(*) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_custkey IS NULL
UNION ALL SELECT 'orphan_part', count(*) FROM part LEFT JOIN lineitem ON l_partkey = p_partkey WHERE l_partkey IS NULL
UNION ALL SELECT 'orphan_line', count(*) FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey IS NULL""")
def gate_orphans(spark, d):
    r = lambda n, **k: t(spark, d, n).select(*(F.col(a).alias(b) for b, a in k.items()))
    gates = {
        "orphan_customer": integrity.orphans(r("customer", key="c_custkey"), r("orders", key="o_custkey"), ["key"]),
        "orphan_part": integrity.orphans(r("part", key="p_partkey"), r("lineitem", key="l_partkey"), ["key"]),
        "orphan_line": integrity.orphans(r("lineitem", key="l_orderkey"), r("orders", key="o_orderkey"), ["key"]),
    }
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("gate"), "n") for k, df in gates.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("""WITH e AS (SELECT DISTINCT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey AND o_orderdate < TIMESTAMP '1997-01-01')
SELECT e.c_custkey, count(*) AS missing FROM e LEFT JOIN lineitem l ON l.l_orderkey = e.o_orderkey AND l.l_shipdate < TIMESTAMP '1996-01-01' WHERE l.l_orderkey IS NULL GROUP BY e.c_custkey""")
def gate_missing_quote(spark, d):
    c, o = t(spark, d, "customer"), t(spark, d, "orders")
    e = c.join(o, (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp"))).select("c_custkey", F.col("o_orderkey").alias("key")).distinct()
    have = t(spark, d, "lineitem").where(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp")).select(F.col("l_orderkey").alias("key"))
    return integrity.missing_rows(e, have, ["key"]).join(e, "key").groupBy("c_custkey").agg(F.count("*").alias("missing"))


@query("""SELECT o_orderkey, o_orderstatus, o_orderpriority, o_custkey FROM orders
WHERE o_orderkey % 3 <> 0 AND (o_orderkey % 11 = 0 OR (o_orderkey % 13 = 0 AND o_orderstatus IS NOT NULL) OR (o_orderkey % 17 = 0 AND o_orderpriority <> '5-LOW'))""")
def gate_mismatch(spark, d):
    """Rows that differ from a copy in which some customers, statuses (made
    null) and priorities are planted wrong and some rows are missing."""
    left = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey")
    key = F.col("o_orderkey")
    copy = left.where(key % 3 != 0).select(
        "o_orderkey",
        F.when(key % 13 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(key % 17 == 0, "5-LOW").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        (F.col("o_custkey") + F.when(key % 11 == 0, 1).otherwise(0)).alias("o_custkey"),
    )
    return integrity.mismatches(left, copy, ["o_orderkey"], ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING list_sort(list(DISTINCT l_linestatus)) <> ['F', 'O']")
def set_completeness(spark, d):
    return integrity.incomplete_sets(t(spark, d, "lineitem"), ["l_orderkey"], "l_linestatus", ["F", "O"]).select("l_orderkey")


@query("SELECT p_partkey FROM (SELECT p_partkey, sha256('sample-v1|7|' || p_partkey) AS h FROM part ORDER BY h LIMIT 40) ORDER BY p_partkey")
def hash_sample(spark, d):
    """A deterministic sampling operator: its size is the feature."""
    return selection.hash_sample(t(spark, d, "part"), 40, "sample-v1", 7, "p_partkey").select("p_partkey")


@query("""SELECT s_suppkey, s_nationkey, list_element(['iv', 'delta', 'gamma', 'vega', 'theta', 'rho'], (r % 6 + 1)::INTEGER) AS target, r AS slot
FROM (SELECT *, (row_number() OVER (PARTITION BY s_nationkey ORDER BY sha256('alloc|11|' || s_suppkey), s_suppkey) - 1)::INTEGER AS r FROM supplier)""")
def allocation_round_robin(spark, d):
    out = selection.allocate_round_robin(t(spark, d, "supplier"), ["iv", "delta", "gamma", "vega", "theta", "rho"], "alloc", 11, "s_suppkey", "s_nationkey")
    return out.select("s_suppkey", "s_nationkey", "target", "slot")


@query("""WITH i AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000), e AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
SELECT count(*) AS requested, count(*) FILTER (WHERE o_orderkey NOT IN (SELECT o_orderkey FROM e)) AS inserted, count(*) FILTER (WHERE o_orderkey IN (SELECT o_orderkey FROM e)) AS unchanged FROM i""")
def merge_summary(spark, d):
    o = t(spark, d, "orders")
    return tables.insert_only_merge(o.where("o_orderstatus = 'F'"), o.where("o_totalprice > 100000"), ["o_orderkey"])[1]


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'F'")
def merge_insert_only(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return tables.insert_only_merge(o.where("o_orderstatus = 'F'"), o.where("o_totalprice > 100000"), ["o_orderkey"])[0].drop("o_orderstatus")


@query("""(SELECT 'left' AS side, * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem WHERE l_linenumber <= 3 EXCEPT ALL SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem WHERE l_linenumber >= 3))
UNION ALL (SELECT 'right' AS side, * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem WHERE l_linenumber >= 3 EXCEPT ALL SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem WHERE l_linenumber <= 3))""")
def replay_diff(spark, d):
    x = t(spark, d, "lineitem").select("l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")
    a, b = integrity.multiset_difference(x.where("l_linenumber <= 3").drop("l_linenumber"), x.where("l_linenumber >= 3").drop("l_linenumber"))
    cols = ["side", *a.columns]
    return a.withColumn("side", F.lit("left")).select(*cols).unionByName(b.withColumn("side", F.lit("right")).select(*cols))


@query("SELECT CAST(x AS DATE) AS date FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1996-12-31', INTERVAL 1 DAY) g(x) WHERE isodow(x) < 6")
def business_calendar(spark, d):
    return calendar.business_days(spark, "1995-01-01", "1996-12-31")


@query("""WITH x AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)
SELECT date, (CASE isodow(date) WHEN 6 THEN date + 2 WHEN 7 THEN date + 1 ELSE date END)::DATE AS adjusted, (CASE isodow(date) WHEN 1 THEN date - 3 WHEN 7 THEN date - 2 ELSE date - 1 END)::DATE AS before,
 (SELECT max(y.date) FROM x y WHERE y.date < x.date) AS previous_seen FROM x""")
def prev_business_day(spark, d):
    x = t(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct().withColumn("entity", F.lit(1))
    # One row a date at most: the distinct dates are few by nature.
    out = calendar.with_previous(x, "entity", "date", "previous_seen")
    return out.select("date", calendar.following(F.col("date")).alias("adjusted"), calendar.previous(F.col("date")).alias("before"), "previous_seen")


_NODES = [(0.0, 0.05), (0.2, 0.08), (0.5, 0.03)]


@query(f"""{_O}, v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, tau FROM opt)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 round(CASE WHEN tau <= 0 THEN 0.05 WHEN tau <= 0.2 THEN 0.05 + 0.03 * tau / 0.2 WHEN tau <= 0.5 THEN 0.08 - 0.05 * (tau - 0.2) / 0.3 ELSE 0.03 END, 8) AS value,
 round(CASE WHEN tau <= 0.2 THEN 0.05 * tau + 0.075 * tau * tau WHEN tau <= 0.5 THEN 0.013 + 0.08 * (tau - 0.2) - (0.05 / 0.3) * (tau - 0.2) * (tau - 0.2) / 2 ELSE 0.0295 + 0.03 * (tau - 0.5) END, 8) AS integral FROM v""")
def piecewise_integral(spark, d):
    tau = F.col("tau")
    return options(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(curves.value_column(_NODES, tau), 8).alias("value"), F.round(curves.integral_column(_NODES, F.lit(0.0), tau), 8).alias("integral"))


@query("""WITH l AS (SELECT s_suppkey AS driver, f AS factor, CASE f WHEN 0 THEN 0.5 + 0.004 * (s_suppkey % 50) ELSE 0.1 + 0.002 * (s_suppkey % 30) END::DOUBLE AS loading FROM supplier, (SELECT unnest([0, 1])::INTEGER AS f))
SELECT a.driver AS driver_i, b.driver AS driver_j, round(CASE WHEN a.driver = b.driver THEN 1.0 ELSE sum(a.loading * b.loading) END, 8)::DOUBLE AS rho FROM l a JOIN l b USING (factor) GROUP BY a.driver, b.driver""")
def factor_correlation(spark, d):
    return dependence.correlation(_loadings(spark, d)).withColumn("rho", _eight("rho"))


def _eight(name):
    """Eight places in doubles alone: for many cells; they are far from halves."""
    return F.rint(F.col(name) * 1e8) / 1e8


def _loadings(spark, d):
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("driver"), F.explode(F.array(F.lit(0), F.lit(1))).alias("factor"))
    value = F.when(F.col("factor") == 0, 0.5 + 0.004 * (F.col("driver") % 50)).otherwise(0.1 + 0.002 * (F.col("driver") % 30))
    return s.withColumn("loading", value)


@query("""WITH l AS (SELECT s_suppkey AS driver, f AS factor, CASE f WHEN 0 THEN 0.5 + 0.004 * (s_suppkey % 50) ELSE 0.1 + 0.002 * (s_suppkey % 30) END::DOUBLE AS loading FROM supplier, (SELECT unnest([0, 1])::INTEGER AS f) WHERE s_nationkey < 2)
SELECT a.driver AS driver_i, b.driver AS driver_j, round(CASE WHEN a.driver = b.driver THEN 1.0 ELSE sum(a.loading * b.loading) END, 8)::DOUBLE AS rho FROM l a JOIN l b USING (factor) GROUP BY a.driver, b.driver""")
def principal_submatrix(spark, d):
    few = t(spark, d, "supplier").where("s_nationkey < 2").select(F.col("s_suppkey").alias("driver"))
    return dependence.submatrix_of(_loadings(spark, d), few).select("driver_i", "driver_j", _eight("rho").alias("rho"))


@query("SELECT s_suppkey AS driver, round(1.0 - (power(0.5 + 0.004 * (s_suppkey % 50), 2) + power(0.1 + 0.002 * (s_suppkey % 30), 2)), 8)::DOUBLE AS own FROM supplier")
def own_variance(spark, d):
    return dependence.own_variance(_loadings(spark, d)).withColumn("own", F.round("own", 8))


@query("""WITH l AS (SELECT s_suppkey AS driver, f AS factor, CASE f WHEN 0 THEN 0.5 + 0.004 * (s_suppkey % 50) ELSE 0.1 + 0.002 * (s_suppkey % 30) END::DOUBLE AS loading FROM supplier, (SELECT unnest([0, 1])::INTEGER AS f)),
r AS (SELECT a.driver AS driver_i, b.driver AS driver_j, CASE WHEN a.driver = b.driver THEN 1.0 ELSE sum(a.loading * b.loading) END::DOUBLE AS rho FROM l a JOIN l b USING (factor) GROUP BY a.driver, b.driver)
SELECT driver_i, driver_j, CASE WHEN (driver_i + 2 * driver_j) % 89 <> 0 THEN round(rho + 0.001, 8) END AS stated, round(rho, 8) AS rho FROM r
WHERE (driver_i + 2 * driver_j) % 89 = 0 OR (31 * driver_i + driver_j) % 97 = 0""")
def provenance_check(spark, d):
    """A stated matrix of all suppliers' pairs with cells planted wrong and
    cells left out, against that of the loadings."""
    load = _loadings(spark, d)
    i, j = F.col("driver_i"), F.col("driver_j")
    stated = dependence.correlation(load).where((i + 2 * j) % 89 != 0).withColumn("rho", F.col("rho") + F.when((31 * i + j) % 97 == 0, 0.001).otherwise(0.0))
    return dependence.provenance_errors(stated, load).select("driver_i", "driver_j", _eight("stated").alias("stated"), _eight("rho").alias("rho"))


_BANDS = [("weak", 0.0, 1.0), ("learning", 0.3, 1.5), ("strong", 0.8, 0.25)]


@query("SELECT c_custkey, CASE WHEN r >= 0.8 THEN 'strong' WHEN r >= 0.3 THEN 'learning' ELSE 'weak' END AS band FROM (SELECT c_custkey, (c_custkey % 101) / 100::DOUBLE AS r FROM customer)")
def mastery_band(spark, d):
    rate = (F.col("c_custkey") % 101) / F.lit(100.0)
    return t(spark, d, "customer").select("c_custkey", selection.mastery_band(rate, _BANDS).alias("band"))


@query("""WITH k AS (SELECT c_custkey AS task_id, c_nationkey % 5 AS stage, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE (c_custkey % 101) / 100::DOUBLE END AS r FROM customer),
b AS (SELECT *, CASE WHEN stage < 2 THEN 'replay' WHEN stage = 2 THEN 'current' WHEN stage = 3 THEN 'explore' END AS bucket, CASE WHEN coalesce(r, 0) >= 0.8 THEN 0.25 WHEN coalesce(r, 0) >= 0.3 THEN 1.5 ELSE 1.0 END::DOUBLE AS score FROM k WHERE stage < 4),
m AS (SELECT *, CASE bucket WHEN 'replay' THEN 0.2 WHEN 'current' THEN 0.6 ELSE 0.2 END::DOUBLE AS mass, sum(score) OVER (PARTITION BY bucket) AS total FROM b)
SELECT task_id, bucket, round(mass * score / total / (SELECT sum(mass) FROM (SELECT DISTINCT bucket, mass FROM m)), 10) AS weight FROM m""")
def curriculum_weights(spark, d):
    rate = F.when(F.col("c_custkey") % 7 != 0, (F.col("c_custkey") % 101) / F.lit(100.0))
    tasks = t(spark, d, "customer").select(F.col("c_custkey").alias("task_id"), (F.col("c_nationkey") % 5).alias("stage"), rate.alias("pass_rate"))
    return selection.curriculum_weights(tasks, {"replay": 0.2, "current": 0.6, "explore": 0.2}, _BANDS, 2).withColumn("weight", F.round("weight", 10))


@query("""WITH r(rule_id, rule_order, low, high, brand, reason) AS (VALUES ('small', 1, 1, 10, NULL, 'small part'), ('mid-b1', 2, 5, 30, 'Brand#1%', 'first brands'), ('mid', 3, 5, 30, NULL, 'middle part'))
SELECT p_partkey, m.rule_id IS NOT NULL AS compatible, m.rule_id, m.reason FROM part LEFT JOIN LATERAL (SELECT rule_id, reason FROM r WHERE p_size BETWEEN low AND high AND (brand IS NULL OR p_brand LIKE brand) ORDER BY rule_order LIMIT 1) m ON true""")
def compatibility_rules(spark, d):
    rules = tables.values(spark, [("small", 1, 1, 10, None, "small part"), ("mid-b1", 2, 5, 30, "Brand#1%", "first brands"), ("mid", 3, 5, 30, None, "middle part")], "rule_id string, rule_order int, low int, high int, brand string, reason string")
    match = F.col("p_size").between(F.col("low"), F.col("high")) & (F.col("brand").isNull() | F.expr("p_brand like brand"))
    return selection.first_matching_rule(t(spark, d, "part"), rules, "p_partkey", match)


@query("""WITH c AS (SELECT p_partkey, p_brand, p_type, p_size FROM part), k(brand, status) AS (VALUES ('Brand#11', 'ACTIVE'), ('Brand#12', 'RETIRED'), ('Brand#21', 'ACTIVE'))
SELECT p_partkey, coalesce(status = 'ACTIVE', false) AS admitted, CASE WHEN status IS NULL THEN 'no such capability' WHEN status <> 'ACTIVE' THEN 'status ' || status ELSE 'ok' END AS reason FROM c LEFT JOIN k ON p_brand = brand""")
def capability_gate(spark, d):
    caps = tables.values(spark, [("Brand#11", "ACTIVE"), ("Brand#12", "RETIRED"), ("Brand#21", "ACTIVE")], "p_brand string, status string")
    return selection.capability_gate(t(spark, d, "part").select("p_partkey", "p_brand"), caps, ["p_brand"]).select("p_partkey", "admitted", "reason")


@query("""SELECT p_partkey AS parent_id, p_size + 0 AS old_size, 40 AS new_size FROM part WHERE p_size < 40""")
def mutation(spark, d):
    tasks = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("task_id"), F.create_map(F.lit("size"), F.col("p_size"), F.lit("level"), F.lit(3)).alias("coordinates"), "p_partkey", "p_size")
    child = selection.mutate(tasks, {"size": 40}, allowed=["size"], most_changed=1)
    return child.select(F.col("parent_id").cast("long").alias("parent_id"), F.element_at("coordinates", "size").alias("new_size")).join(tasks.select(F.col("p_partkey").alias("parent_id"), F.col("p_size").alias("old_size")), "parent_id").select("parent_id", "old_size", "new_size")


@query("""WITH q AS (SELECT l_partkey, l_shipdate AS ts, max(l_extendedprice) AS price FROM lineitem GROUP BY ALL), e AS (SELECT DISTINCT o.o_orderkey, l.l_partkey, o.o_orderdate AS ts FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey)
SELECT e.o_orderkey, e.l_partkey, q.price FROM e ASOF LEFT JOIN q ON e.l_partkey = q.l_partkey AND e.ts >= q.ts""")
def as_of_quotes(spark, d):
    line = t(spark, d, "lineitem")
    q = line.groupBy("l_partkey", F.col("l_shipdate").alias("ts")).agg(F.max("l_extendedprice").alias("price"))
    e = t(spark, d, "orders").join(line, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "l_partkey", F.col("o_orderdate").alias("ts")).distinct()
    return selection.as_of(e, q, ["l_partkey"], "ts", ["price"]).select("o_orderkey", "l_partkey", "price")


@query(f"""{_O} SELECT round(greatest(0.01, 0.2 - 0.1 * k + 0.3 * k * k + 0.05 * tau), 8) AS vol, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, ln(strike / spot) AS k FROM opt)""")
def smile_vol(spark, d):
    from voltide.operators.quotes import smile_vol as smile

    k = F.ln(F.col("strike") / F.col("spot"))
    lit = lambda x: F.lit(x)
    return options(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(smile(lit(0.2), lit(-0.1), lit(0.3), lit(0.05), k, F.col("tau")), 8).alias("vol"))


@query("""WITH l AS (SELECT l_partkey % 10 AS book, l_extendedprice * (l_discount - 0.05) AS loss FROM lineitem), v AS (SELECT book, quantile_cont(loss, 0.99) AS var99 FROM l GROUP BY book)
SELECT l.book, round(any_value(var99), 4) AS var99, round(avg(loss), 4) AS es99, count(*) AS n_tail FROM l JOIN v USING (book) WHERE loss >= var99 GROUP BY l.book""")
def var_es(spark, d):
    """Value at risk and expected shortfall of a loss sample per book."""
    x = t(spark, d, "lineitem").select((F.col("l_partkey") % 10).alias("book"), (F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("loss"))
    v = x.groupBy("book").agg(F.percentile("loss", 0.99).alias("var99"))
    return x.join(v, "book").where("loss >= var99").groupBy("book").agg(F.round(F.first("var99"), 4).alias("var99"), F.round(F.avg("loss"), 4).alias("es99"), F.count("*").alias("n_tail"))
