"""Pricing operators on DataFrames: Arrow batches into the NumPy kernels.

Each operator solves a row once and returns all of its outputs, so that no
expression is evaluated twice by the optimizer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltide.functions import bsm
from voltide.functions.canonical import decimal_column
from voltide.session import spread

INPUTS = ("call_put", "spot", "strike", "tau", "rate", "yield")
METRICS = ("iv", "delta", "gamma", "vega_1volpt", "theta_1calendar_day", "rho_1pct")


def midpoint(bid: Column, ask: Column) -> Column:
    """Exact decimal midpoint, cast to double once; null where bid > ask."""
    b, a = bid.cast("decimal(24,8)"), ask.cast("decimal(24,8)")
    return F.when(b <= a, ((b + a).cast("decimal(28,8)") * F.lit(0.5).cast("decimal(2,1)")).cast("double"))


def price_bounds(call_put: Column, spot: Column, strike: Column, tau: Column, rate: Column, q: Column) -> tuple[Column, Column]:
    """No-arbitrage bounds as columns; they stay in generated code."""
    forward, cash = spot * F.exp(-q * tau), strike * F.exp(-rate * tau)
    call = call_put == "call"
    lower = F.greatest(F.when(call, forward - cash).otherwise(cash - forward), F.lit(0.0))
    return lower, F.when(call, forward).otherwise(cash)


def _arrays(b: pd.DataFrame, names) -> list[np.ndarray]:
    return [b[n].to_numpy(float, na_value=np.nan) for n in names]


def _append(df: DataFrame, per_batch, extra: str, inputs: list[Column]) -> DataFrame:
    """``df`` with columns that a kernel makes from ``inputs``."""
    names = [f"__in{i}" for i in range(len(inputs))]
    wide = spread(df.select("*", *(x.alias(n) for x, n in zip(inputs, names, strict=True))))
    schema = T.StructType(df.schema.fields + T.StructType.fromDDL(extra).fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns=names).assign(**per_batch(b.rename(columns=dict(zip(names, range(len(names)), strict=True)))))

    return wide.mapInPandas(run, schema)


def with_greeks(df: DataFrame, call_put: Column, spot: Column, strike: Column, tau: Column, rate: Column, q: Column, sigma: Column, *, text: bool = False, more: bool = False) -> DataFrame:
    """Price and Greeks of each row at a given volatility."""
    names = ["price", *bsm.GREEKS]

    def kernel(b: pd.DataFrame) -> dict:
        call = (b[0] == "call").to_numpy()
        args = _arrays(b, range(1, 7))
        with np.errstate(all="ignore"):
            out = bsm.greeks(call, *args)
            out |= bsm.more_greeks(call, *args) if more else {}
        return out

    if more:
        names += ["dividend_rho", "vanna", "vomma", "charm", "speed", "zomma", "color", "veta", "ultima", "dual_delta", "dual_gamma"]
    out = _append(df, kernel, ", ".join(f"{n} double" for n in names), [call_put, spot, strike, tau, rate, q, sigma])
    return _texts(out, names) if text else out


def _texts(df: DataFrame, names) -> DataFrame:
    """Columns as eight-place texts, made in generated code."""
    return df.withColumns({n: decimal_column(F.col(n)) for n in names})


def with_implied_volatility(df: DataFrame, call_put: Column, spot: Column, strike: Column, tau: Column, rate: Column, q: Column, observed: Column, *, greeks: bool = False, text: bool = False) -> DataFrame:
    """iv_status, implied_volatility and iterations of each row; with
    ``greeks`` also the Greeks at the unrounded root."""

    def kernel(b: pd.DataFrame) -> dict:
        call = (b[0] == "call").to_numpy()
        known = b[0].isin(["call", "put"]).to_numpy()
        args = _arrays(b, range(1, 7))
        args[0] = np.where(known, args[0], np.nan)
        status, root = bsm.implied_volatility(call, *args)
        out = {"iv_status": status, "implied_volatility": root, "iterations": np.where(status == bsm.OK, bsm.BISECTIONS, 0)}
        if greeks:
            with np.errstate(all="ignore"):
                g = bsm.greeks(call, *args[:5], root)
            out |= {k: g[k] for k in bsm.GREEKS}
        return out

    extra = "iv_status string, implied_volatility double, iterations int"
    if greeks:
        extra += "".join(f", {k} double" for k in bsm.GREEKS)
    out = _append(df, kernel, extra, [call_put, spot, strike, tau, rate, q, observed])
    return _texts(out, ["implied_volatility", *(bsm.GREEKS if greeks else ())]) if text else out


def with_bisection_root(df: DataFrame, call_put: Column, spot: Column, strike: Column, tau: Column, rate: Column, q: Column, observed: Column) -> DataFrame:
    """The root of the 80 halvings without status checks, on the approximate
    price of ``price_column``; each row's root is one vector operation wide."""

    def kernel(b: pd.DataFrame) -> dict:
        return {"root": bsm.bisect((b[0] == "call").to_numpy(), *_arrays(b, range(1, 7)), bsm.approximate_cdf)}

    return _append(df, kernel, "root double", [call_put, spot, strike, tau, rate, q, observed])


def project_metric(solved: DataFrame, metric: str, *keys: str) -> DataFrame:
    """One metric of a solved table."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    return solved.select(*keys, F.col("implied_volatility" if metric == "iv" else metric).alias("value"))


def normal_cdf_column(x: Column) -> Column:
    """Rational approximation of the normal distribution (error below 7.5e-8),
    for plans that must stay in generated code."""
    k = 1.0 / (1.0 + 0.2316419 * F.abs(x))
    poly = k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    tail = 0.3989422804014327 * F.exp(-0.5 * x * x) * poly
    return F.when(x >= 0, 1.0 - tail).otherwise(tail)


def price_column(call: Column, spot: Column, strike: Column, tau: Column, rate: Column, q: Column, sigma: Column) -> Column:
    """Price in generated code, by the approximation above."""
    root = sigma * F.sqrt(tau)
    d1 = (F.ln(spot / strike) + (rate - q + 0.5 * sigma * sigma) * tau) / root
    sign = F.when(call, 1.0).otherwise(-1.0)
    return sign * (spot * F.exp(-q * tau) * normal_cdf_column(sign * d1) - strike * F.exp(-rate * tau) * normal_cdf_column(sign * (d1 - root)))
