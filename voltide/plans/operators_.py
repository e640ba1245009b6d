"""Queries of operators that SQL can't express; tests hold brute-force checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltide.operators import chain, integrity, paths, pricing, quotes
from voltide.plans.endpoint import Endpoint
from voltide.plans.market import options, t
from voltide.plans.registry import query
from voltide.session import Scratch

DAYS = [f"2026-01-{n:02d}" for n in (2, 5, 6, 7, 8, 9, 12, 13, 14, 15)]


def _daily(spark, d):
    """Every part as an underlying."""
    loading = F.array(F.lit(0.2) + F.lit(0.05) * (F.col("p_size") % 10), F.lit(0.3))
    parts = t(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("underlying_id"), F.col("p_retailprice").cast("decimal(24,2)").cast("string").alias("spot"), loading.alias("loading"))
    return paths.make_paths(spark, paths.MarketSpec(), DAYS, underlyings=parts)


@query()
def keyed_rng_paths(spark, d):
    """Correlated tick-rounded closes with bridged highs and lows."""
    return _daily(spark, d)


@query()
def bridge_ohlc(spark, d):
    return _daily(spark, d).select("underlying_id", "date", (F.col("spot_high") - F.col("spot_low")).alias("range"), (F.col("spot_high") >= F.greatest("spot_open", "spot_close")).alias("high_ok"), (F.col("spot_low") <= F.least("spot_open", "spot_close")).alias("low_ok"))


@query()
def option_quotes(spark, d):
    daily = Scratch(spark).table(_daily(spark, d), "daily")  # read for listings and for quotes
    listing = daily.where(F.col("date") == DAYS[0]).select("underlying_id", F.col("date").alias("listing_date"), F.col("spot_close").alias("spot"))
    contracts = chain.candidate_grid(listing, [5, 30], ["0.9", "1.0", "1.1"])
    return quotes.make_quotes(daily, contracts, paths.MarketSpec())


@query()
def implied_volatility(spark, d):
    o = options(spark, d)
    quote = F.abs(F.col("spot") - F.col("strike")) + F.col("spot") * 0.05
    args = [F.col(x) for x in ("call_put", "spot", "strike", "tau", "rate", "yield")]
    bid, ask = (quote * 0.99).cast("decimal(24,8)"), (quote * 1.01).cast("decimal(24,8)")
    return pricing.with_implied_volatility(o, *args, pricing.midpoint(bid, ask), text=True).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "iv_status", "implied_volatility", "iterations")


@query("SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def endpoint_query(spark, d):
    """A query through the restricted endpoint's guard."""
    e = Endpoint(spark, {"market.nation": t(spark, d, "nation"), "market.region": t(spark, d, "region")})
    return e.frame("WITH x AS (SELECT n_regionkey FROM market.nation) SELECT r_name, count(*) AS n FROM x JOIN market.region ON n_regionkey = r_regionkey GROUP BY r_name")


_ROW = "length('v' || p_partkey) || ':v' || p_partkey || length('v' || p_brand) || ':v' || p_brand || length('v' || p_size) || ':v' || p_size"


@query(f"""WITH r AS (SELECT sha256(length('v' || p_partkey) || ':v' || p_partkey) AS k, sha256({_ROW}) AS h FROM part),
b AS (SELECT left(k, 3) AS bucket, sha256(string_agg(h, '' ORDER BY k)) AS digest FROM r GROUP BY 1),
s AS (SELECT count(*) AS n, [{", ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT)" for i in range(8))}] AS v FROM r)
SELECT 'ordered' AS kind, sha256(string_agg(digest, '' ORDER BY bucket)) AS digest FROM b
UNION ALL SELECT 'multiset', sha256('[' || n || ', "' || array_to_string(v, '", "') || '"]') FROM s""")
def content_digest(spark, d):
    """Ordered and unordered digests of a table."""
    part = t(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    rows = [("ordered", integrity.ordered_digest(part, ["p_partkey"])), ("multiset", integrity.multiset_digest(part))]
    return spark.createDataFrame(rows, "kind string, digest string")


@query("SELECT 'nation' AS table_name, unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS column_name, unnest([1, 2, 3])::INTEGER AS ordinal_position UNION ALL SELECT 'region', unnest(['r_regionkey', 'r_name']), unnest([1, 2])::INTEGER")
def catalog_columns(spark, d):
    from voltide.sources.tables import information_schema

    views = information_schema(spark, {n: t(spark, d, n) for n in ("nation", "region")})
    return views["columns"].select("table_name", "column_name", "ordinal_position")
