"""An option-market reading of the order tables.

Each order line is an option row: spot is the part's retail price, strike the
line's unit price, life a multiple of thirty days, and rate, yield and
volatility come from discount, tax and supplier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def options(spark: SparkSession, d: str) -> DataFrame:
    line, part = t(spark, d, "lineitem"), t(spark, d, "part").select("p_partkey", "p_retailprice")
    return line.join(part, line["l_partkey"] == part["p_partkey"]).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.to_date("l_shipdate").alias("date"),
        F.when(F.col("l_linestatus") == "O", "call").otherwise("put").alias("call_put"),
        F.col("p_retailprice").alias("spot"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("strike"),
        (F.col("l_linenumber") * 30 / F.lit(365.0)).alias("tau"),
        F.col("l_discount").alias("rate"),
        F.col("l_tax").alias("yield"),
        (F.lit(0.1) + F.lit(0.01) * (F.col("l_suppkey") % 20)).alias("sigma"),
        F.col("l_quantity").alias("position"),
    )


#: The same rows in SQL, as the first of a chain of WITH clauses.
OPTIONS_SQL = """opt AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS date,
    CASE WHEN l_linestatus = 'O' THEN 'call' ELSE 'put' END AS call_put,
    p_retailprice AS spot, l_extendedprice / l_quantity AS strike, (l_linenumber * 30) / 365::DOUBLE AS tau,
    l_discount AS rate, l_tax AS yield, 0.1::DOUBLE + 0.01::DOUBLE * (l_suppkey % 20) AS sigma, l_quantity AS position
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def cdf_sql(x: str) -> str:
    """The rational approximation of the normal distribution in SQL."""
    k = f"(1.0::DOUBLE / (1.0::DOUBLE + 0.2316419::DOUBLE * abs({x})))"
    poly = f"{k} * (0.319381530::DOUBLE + {k} * (-0.356563782::DOUBLE + {k} * (1.781477937::DOUBLE + {k} * (-1.821255978::DOUBLE + {k} * 1.330274429::DOUBLE))))"
    tail = f"(0.3989422804014327::DOUBLE * exp(-0.5::DOUBLE * {x} * {x}) * {poly})"
    return f"(CASE WHEN {x} >= 0 THEN 1.0::DOUBLE - {tail} ELSE {tail} END)"


def price_sql(sigma: str = "sigma") -> str:
    root = f"({sigma} * sqrt(tau))"
    d1 = f"((ln(spot / strike) + (rate - yield + 0.5::DOUBLE * {sigma} * {sigma}) * tau) / {root})"
    sign = "(CASE WHEN call_put = 'call' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)"
    return f"({sign} * (spot * exp(-yield * tau) * {cdf_sql(f'({sign} * {d1})')} - strike * exp(-rate * tau) * {cdf_sql(f'({sign} * ({d1} - {root}))')}))"


def series_cdf_sql(x: str) -> str:
    """The normal distribution by its power series, for x between -8 and 8: a
    second way to the same values, good to about 1e-15."""
    step = f"a.t * {x} * {x} / (2 * i.t + 1)"
    terms = "[{'t': k::DOUBLE, 's': 0::DOUBLE} for k in range(1, 121)]"
    return f"(0.5::DOUBLE + exp(-0.5::DOUBLE * {x} * {x}) / sqrt(2 * pi()) * list_reduce(list_prepend({{'t': {x}, 's': {x}}}, {terms}), lambda a, i: {{'t': {step}, 's': a.s + {step}}}).s)"


def exact_sql(source: str, sigma: str = "sigma") -> str:
    """WITH clauses from ``source`` to ``g``: its rows with d1, d2, discounts,
    the density and both probabilities (n1, n2) of the side."""
    clip = lambda x: f"greatest(-8.0::DOUBLE, least(8.0::DOUBLE, {x}))"
    return f"""g1 AS (SELECT *, CASE WHEN call_put = 'call' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sg, {sigma} AS v, sqrt(tau) AS rt, exp(-yield * tau) AS dq, exp(-rate * tau) AS dr FROM {source}),
g2 AS (SELECT *, (ln(spot / strike) + (rate - yield + 0.5::DOUBLE * v * v) * tau) / (v * rt) AS d1 FROM g1),
g3 AS (SELECT *, d1 - v * rt AS d2, exp(-0.5::DOUBLE * d1 * d1) / sqrt(2 * pi()) AS pdf FROM g2),
g4 AS (SELECT *, {clip("sg * d1")} AS x1, {clip("sg * d2")} AS x2 FROM g3),
g AS (SELECT *, {series_cdf_sql("x1")} AS n1, {series_cdf_sql("x2")} AS n2 FROM g4)"""


#: Over the rows of ``exact_sql``.
EXACT = {
    "price": "sg * (spot * dq * n1 - strike * dr * n2)",
    "delta": "sg * dq * n1",
    "gamma": "dq * pdf / (spot * v * rt)",
    "vega_1volpt": "0.01 * spot * dq * pdf * rt",
    "theta_1calendar_day": "(-spot * dq * pdf * v / (2 * rt) + sg * (yield * spot * dq * n1 - rate * strike * dr * n2)) / 365",
    "rho_1pct": "0.01 * sg * strike * tau * dr * n2",
}
