"""Daily option quotes from paths, contracts and a volatility curve.

The model value and the keyed draws of a row are made in Arrow batches; ticks,
spreads and bounds are decimals in generated code.
"""

from __future__ import annotations

import functools
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltide.functions import bsm, curves, rng
from voltide.functions.canonical import tick
from voltide.operators.chain import expected_quotes
from voltide.operators.paths import MarketSpec

# The key of a quote's activity, and its ranges of volume and open interest.
ACTIVITY, VOLUMES, INTERESTS = "option-activity", (25, 475), (500, 4_500)

QUOTE = "date date, underlying_id string, option_id string, call_put string, strike decimal(24,8), expiry date, bid decimal(24,8), ask decimal(24,8), mid decimal(24,8), settlement_price decimal(24,8), volume bigint, open_interest bigint"


def smile_vol(base: Column, skew: Column, curvature: Column, slope: Column, k: Column, tau: Column, least: float = 0.01) -> Column:
    """Quadratic smile in log-moneyness with a term slope and a floor."""
    return F.greatest(F.lit(least), base + skew * k + curvature * k * k + slope * tau)


@functools.lru_cache(maxsize=65_536)
def _mean_vol(vol: tuple, start: float, end: float) -> float:
    return curves.root_mean_square(list(vol), start, end)


def make_quotes(
    daily: DataFrame, contracts: DataFrame, spec: MarketSpec, *, rate: float = 0.03, dividend: float = 0.01, spread: str = "0.01", least_spread: str = "0.01", noise: str = "bid-ask-noise", deviation: float = 0.2, multipliers: tuple[float, float] = (0.5, 1.5)
) -> DataFrame:
    """One quote for each live contract and day; each row stands alone.

    The middle is the model value on the tick; each side's half spread is the
    larger of the least and a part of the middle, times a clipped keyed normal."""
    spark = daily.sparkSession
    # Both sides are dealt out in a number of parts that adaptive execution keeps: a small row becomes many costly ones.
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    live = lambda df, *cols: df.select("underlying_id", *cols).repartition(parts, "underlying_id")
    rows = expected_quotes(live(daily, "date", "spot_close"), live(contracts, "option_id", "call_put", "strike", "expiry", "listing_date"))
    head = f"{spec.snapshot_id}|{spec.seed}"

    def kernel(call: pd.Series, spot: pd.Series, strike: pd.Series, age: pd.Series, life: pd.Series, option: pd.Series, day: pd.Series) -> pd.DataFrame:
        start, end = age.to_numpy(float) / 365.0, life.to_numpy(float) / 365.0
        sigma = np.array([_mean_vol(spec.vol, *key) for key in zip(start.tolist(), end.tolist(), strict=True)])
        full = lambda x: np.full(len(call), x)
        value = bsm.price(call.to_numpy(bool), spot.to_numpy(float), strike.to_numpy(float), end - start, full(rate), full(dividend), sigma)
        names = [f"{o}|{d}" for o, d in zip(option, day, strict=True)]
        seeds = lambda *key: rng.text_seeds(["|".join((head, *key, x)) for x in names])
        draw = lambda side: np.clip(1.0 + deviation * rng.gaussians_of(seeds(noise, side)), *multipliers)
        return pd.DataFrame({"value": np.maximum(value, 0.0), "bid_noise": draw("bid"), "ask_noise": draw("ask"), "activity": rng.uniforms_of(seeds(ACTIVITY))})

    # Only what the kernel reads goes to Python; a row's other values stay where they are.
    made = F.pandas_udf(kernel, "value double, bid_noise double, ask_noise double, activity double")
    number = lambda x: F.col(x).cast("double")
    days = lambda x: F.datediff(F.col(x), F.col("listing_date"))
    rows = rows.withColumn("__made", made(F.col("call_put") == "call", number("spot_close"), number("strike"), days("date"), days("expiry"), F.col("option_id"), F.date_format("date", "yyyy-MM-dd")))
    rows = rows.select("*", *(F.col(f"__made.{x}").alias(f"__{x}") for x in ("value", "bid_noise", "ask_noise", "activity")))

    exact = lambda x: F.col(x).cast("string").cast("decimal(30,18)")
    mid = tick(exact("__value"), spec.increment)
    half = F.greatest(F.lit(Decimal(least_spread)).cast("decimal(24,8)"), (F.col("mid") * F.lit(Decimal(spread))).cast("decimal(24,8)"))
    side = lambda sign, x: tick(F.greatest(F.lit(0).cast("decimal(30,18)"), (F.col("mid") + sign * (F.col("half") * exact(x).cast("decimal(13,12)"))).cast("decimal(30,18)")), spec.increment)
    count = lambda low, width: F.floor(F.lit(low) + F.col("__activity") * width).cast("bigint")
    out = rows.withColumn("mid", mid).withColumn("half", half)
    out = out.withColumns({"bid": side(-1, "__bid_noise"), "ask": side(1, "__ask_noise"), "settlement_price": F.col("mid"), "volume": count(*VOLUMES), "open_interest": count(*INTERESTS)})
    return out.select(*(F.col(x.split()[0]) for x in QUOTE.split(", ")))
