"""Oracles of the pricing kernels: the same values by a power series in SQL.

Values are rounded where both ways agree by far more than the last place shown;
a root is shown where the price tells it apart (a vega that is not next to
nothing), and the price at the root for every row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from voltide.functions import bsm
from voltide.operators import pricing, risk
from voltide.plans.market import EXACT, OPTIONS_SQL, exact_sql, options, t
from voltide.plans.registry import query

_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_ARGS = ("call_put", "spot", "strike", "tau", "rate", "yield")
_PLACES = {"price": 4, "delta": 7, "gamma": 8, "vega_1volpt": 6, "theta_1calendar_day": 6, "rho_1pct": 5}
#: Of a point of volatility: below it a root is not shown.
_LEAST_VEGA = 0.001
_K = ", ".join(_KEYS)


def _cols(*names):
    return [F.col(x) for x in names]


def _off(places: int) -> float:
    """A shift under half a unit of the last place: values that lie on the
    middle between two, as exact prices may, then round alike in both engines."""
    return float(f"0.123e{-places}")


def _shown(name, places):
    return F.round(F.col(name) + _off(places), places) + F.lit(0.0)


def _rounded(name, places):
    return _shown(name, places).alias(name)


def _shown_sql(x: str, places: int) -> str:
    return f"round({x} + {_off(places)!r}::DOUBLE, {places}) + 0.0::DOUBLE"


def _sql(parts: dict[str, str], places: dict[str, int]) -> str:
    return ", ".join(f"{_shown_sql(parts[k], n)} AS {k}" for k, n in places.items())


@query(f"WITH {OPTIONS_SQL}, {exact_sql('opt')} SELECT {_K}, {_sql(EXACT, _PLACES)} FROM g")
def greeks_exact(spark, d):
    """Price and Greeks of every row by the product's kernel."""
    out = pricing.with_greeks(options(spark, d).select(*_KEYS, *_ARGS, "sigma"), *_cols(*_ARGS, "sigma"))
    return out.select(*_KEYS, *(_rounded(k, n) for k, n in _PLACES.items()))


_IV_SHOWN = {k: n - 1 for k, n in _PLACES.items() if k != "price"}


@query(f"""WITH {OPTIONS_SQL}, {exact_sql('opt')}, s AS (SELECT *, {EXACT['vega_1volpt']} >= {_LEAST_VEGA} AS told FROM g)
SELECT {_K}, told, CASE WHEN told THEN 'OK' END AS iv_status, CASE WHEN told THEN round(sigma, 5) END AS implied_volatility, {", ".join(f"CASE WHEN told THEN {_shown_sql(EXACT[k], n)} END AS {k}" for k, n in _IV_SHOWN.items())} FROM s""")
def market_greeks_exact(spark, d):
    """Every row priced, solved and read again: root and Greeks at the root."""
    o = options(spark, d).select(*_KEYS, *_ARGS, "sigma")
    priced = pricing.with_greeks(o, *_cols(*_ARGS, "sigma")).select(*o.columns, F.col("price").alias("observed"), (F.col("vega_1volpt") >= _LEAST_VEGA).alias("told"))
    solved = pricing.with_implied_volatility(priced, *_cols(*_ARGS, "observed"), greeks=True)
    shown = lambda x: F.when(F.col("told"), x)
    return solved.select(*_KEYS, "told", shown(F.col("iv_status")).alias("iv_status"), shown(F.round("implied_volatility", 5)).alias("implied_volatility"), *(shown(_shown(k, n)).alias(k) for k, n in _IV_SHOWN.items()))


_QUOTED = "(abs(spot - strike) + spot * 0.050617283945)"


@query(f"""WITH {OPTIONS_SQL}, q AS (SELECT *, {_QUOTED} AS observed, spot * exp(-yield * tau) AS f, strike * exp(-rate * tau) AS c FROM opt), {exact_sql('q', '5.0::DOUBLE')},
b AS (SELECT *, greatest(CASE WHEN call_put = 'call' THEN f - c ELSE c - f END, 0) AS lower, CASE WHEN call_put = 'call' THEN f ELSE c END AS upper, {EXACT['price']} AS top FROM g),
s AS (SELECT *, CASE WHEN NOT (observed >= lower AND observed < upper) THEN 'OUT_OF_BOUNDS' WHEN observed > top THEN 'NO_BRACKET' ELSE 'OK' END AS iv_status FROM b)
SELECT {_K}, iv_status, CASE WHEN iv_status = 'OK' THEN {_shown_sql("observed", 3)} END AS price_at_root, CASE WHEN iv_status = 'OK' THEN 80 ELSE 0 END::INTEGER AS iterations FROM s""")
def implied_volatility_exact(spark, d):
    """Statuses of every row's quote, and the kernel's price at its root."""
    o = options(spark, d).select(*_KEYS, *_ARGS).withColumn("observed", F.abs(F.col("spot") - F.col("strike")) + F.col("spot") * 0.050617283945)
    solved = pricing.with_implied_volatility(o, *_cols(*_ARGS, "observed"))
    again = pricing.with_greeks(solved, *_cols(*_ARGS, "implied_volatility"))
    return again.select(*_KEYS, "iv_status", F.when(F.col("iv_status") == bsm.OK, _shown("price", 3)).alias("price_at_root"), "iterations")


@query(f"""WITH {OPTIONS_SQL}, q AS (SELECT *, CASE l_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN -1.0 WHEN 2 THEN 2 * spot + strike WHEN 3 THEN spot * exp(-yield * tau) ELSE 1.0 END::DOUBLE AS observed FROM opt)
SELECT {_K}, CASE WHEN l_suppkey % 5 = 0 OR l_suppkey % 5 = 4 THEN 'INVALID_INPUT' WHEN l_suppkey % 5 = 3 AND call_put = 'put' AND spot * exp(-yield * tau) < strike * exp(-rate * tau) AND spot * exp(-yield * tau) >= strike * exp(-rate * tau) - spot * exp(-yield * tau) THEN 'inside' ELSE 'OUT_OF_BOUNDS' END AS iv_status FROM q""")
def implied_volatility_refused(spark, d):
    """Quotes that are missing, negative, too high, at a bound, or of rows
    without a life."""
    case = F.col("l_suppkey") % 5
    o = options(spark, d).select(*_KEYS, *_ARGS)
    quote = F.when(case == 1, -1.0).when(case == 2, 2 * F.col("spot") + F.col("strike")).when(case == 3, F.col("spot") * F.exp(-F.col("yield") * F.col("tau"))).when(case == 4, 1.0)
    o = o.withColumn("observed", quote).withColumn("tau", F.when(case == 4, 0.0).otherwise(F.col("tau")))
    solved = pricing.with_implied_volatility(o, *_cols(*_ARGS, "observed"))
    return solved.select(*_KEYS, F.when(F.col("iv_status").isin(bsm.OK, bsm.NO_BRACKET), "inside").otherwise(F.col("iv_status")).alias("iv_status"))


_CARRY = "((rate - yield) / (v * rt) - d2 / (2 * tau))"
_VEGA, _GAMMA = "(spot * dq * pdf * rt)", "(dq * pdf / (spot * v * rt))"
_MORE = {
    "vanna": "-dq * pdf * d2 / v",
    "vomma": f"{_VEGA} * d1 * d2 / v",
    "charm": f"sg * yield * dq * n1 - dq * pdf * {_CARRY}",
    "speed": f"-{_GAMMA} / spot * (d1 / (v * rt) + 1)",
    "zomma": f"{_GAMMA} * (d1 * d2 - 1) / v",
    "color": f"{_GAMMA} * (yield + 1 / (2 * tau) + d1 * {_CARRY})",
    "veta": f"{_VEGA} * (yield + d1 * (rate - yield) / (v * rt) - (1 + d1 * d2) / (2 * tau))",
    "ultima": f"-{_VEGA} / (v * v) * (d1 * d2 * (1 - d1 * d2) + d1 * d1 + d2 * d2)",
    "dual_delta": "-sg * dr * n2",
    "dual_gamma": "dr * exp(-0.5::DOUBLE * d2 * d2) / sqrt(2 * pi()) / (strike * v * rt)",
    "dividend_rho": "-sg * spot * tau * dq * n1",
}
_MORE_PLACES = {"vanna": 5, "vomma": 1, "charm": 5, "speed": 8, "zomma": 6, "color": 6, "veta": 2, "ultima": -1, "dual_delta": 7, "dual_gamma": 8, "dividend_rho": 4}


@query(f"WITH {OPTIONS_SQL}, {exact_sql('opt')} SELECT {_K}, {_sql(_MORE, _MORE_PLACES)} FROM g")
def more_greeks(spark, d):
    """Higher and mixed sensitivities of every row."""
    o = options(spark, d).select(*_KEYS, *_ARGS, "sigma")
    return pricing.with_greeks(o, *_cols(*_ARGS, "sigma"), more=True).select(*_KEYS, *(_rounded(k, n) for k, n in _MORE_PLACES.items()))


@query(f"""WITH {OPTIONS_SQL}, {exact_sql('opt')}
SELECT l_partkey % 20 AS book, {", ".join(f"round(sum(position * 100 * {EXACT[k]}), 0) AS {k}" for k in ("price", "delta", "vega_1volpt"))} FROM g GROUP BY ALL""")
def portfolio_value(spark, d):
    """Value and sensitivities of each book."""
    priced = pricing.with_greeks(options(spark, d), *_cols(*_ARGS, "sigma")).withColumn("book", F.col("l_partkey") % 20).withColumn("contract_multiplier", F.lit(100))
    sums = risk.portfolio_greeks(priced, ["book"], ["price", "delta", "vega_1volpt"])
    return sums.select("book", *(F.round(x, 0).alias(x) for x in ("price", "delta", "vega_1volpt")))


@query(f"""WITH {OPTIONS_SQL} SELECT DISTINCT {_K}, round(CASE WHEN l_suppkey % 7 = 0 THEN 0.01 * l_linenumber ELSE 0 END, 6)::DOUBLE AS gap FROM opt""")
def pair_parity(spark, d):
    """Put-call parity of a call and a put on every row's terms; calls of some
    suppliers are planted off by a cent a line."""
    from voltide.operators import integrity

    o = options(spark, d).select(*_KEYS, *_ARGS[1:], "sigma").withColumn("call_put", F.explode(F.array(F.lit("call"), F.lit("put"))))
    off = F.when((F.col("call_put") == "call") & (F.col("l_suppkey") % 7 == 0), F.lit(0.01) * F.col("l_linenumber")).otherwise(0.0)
    priced = pricing.with_greeks(o, *_cols(*_ARGS, "sigma")).withColumn("price", F.col("price") + off)
    gaps = integrity.parity_gap(priced, [*_KEYS, *_ARGS[1:]])  # lines that repeat a key differ in their terms
    return gaps.select(*_KEYS, (F.round("gap", 6) + F.lit(0.0)).alias("gap")).distinct()


_MOVES = [(i, -0.1 + 0.02 * i, 0.01 * ((i * 7) % 5 - 2), float(i % 3)) for i in range(11)]


@query(f"""WITH {OPTIONS_SQL}, sc(scenario, spot_move, vol_move, days) AS (VALUES {", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE)" for i, a, b, c in _MOVES)}),
m AS (SELECT l_partkey % 5 AS book, scenario, position, call_put, spot * (1 + spot_move) AS spot, strike, greatest(tau - days / 365, 1e-6) AS tau, rate, yield, greatest(sigma + vol_move, 1e-6) AS sigma FROM opt CROSS JOIN sc),
{exact_sql('m').replace("g1 AS", "a1 AS").replace("g2 AS", "a2 AS").replace("g3 AS", "a3 AS").replace("g4 AS", "a4 AS").replace("FROM g1", "FROM a1").replace("FROM g2", "FROM a2").replace("FROM g3", "FROM a3").replace("FROM g4", "FROM a4").replace("g AS (", "moved AS (")}, {exact_sql('opt')},
now AS (SELECT l_partkey % 5 AS book, sum(position * {EXACT['price']}) AS value FROM g GROUP BY ALL),
l AS (SELECT x.book, scenario, any_value(value) - sum(position * {EXACT['price']}) AS loss FROM moved x JOIN now USING (book) GROUP BY x.book, scenario),
c AS (SELECT book, quantile_cont(loss, 0.9) AS var FROM l GROUP BY book)
SELECT l.book, round(any_value(c.var), 0) AS var90, round(avg(loss), 0) AS es90, count(*) AS n_tail FROM l JOIN c USING (book) WHERE loss >= c.var GROUP BY l.book""")
def full_revaluation_var(spark, d):
    """Every position priced again at each scenario; VaR and shortfall by book."""
    scenarios = spark.createDataFrame(_MOVES, "scenario long, spot_move double, vol_move double, days double")
    books = options(spark, d).withColumn("book", F.col("l_partkey") % 5)
    out = risk.full_revaluation(books, scenarios, ["book"], 0.9)
    return out.select("book", F.round("var", 0).alias("var90"), F.round("es", 0).alias("es90"), "n_tail")
