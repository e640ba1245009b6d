"""Option chains: candidate grids, contracts, liquidity and selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltide.functions.canonical import moneyness_column, tick
from voltide.operators.calendar import following
from voltide.operators.numbering import with_positions
from voltide.session import merged


def candidate_grid(listings: DataFrame, expiry_days: Sequence[int], moneyness: Sequence[str] | None = None, increment: str = "0.5", multiplier: str = "100", *, strikes: Sequence[str] | None = None) -> DataFrame:
    """Every expiry, strike and side of each listing (underlying_id,
    listing_date, spot): rows multiply by a fixed number, nothing is shuffled.

    A strike is the nearest multiple of the increment to a part of the spot
    (``moneyness``) or to a price (``strikes``), one of which is given; an expiry
    that falls on a weekend moves to the next business day.
    """
    if (moneyness is None) == (strikes is None):
        raise ValueError("give either moneyness or strikes")
    arr = lambda xs, t: F.array(*(F.lit(x).cast(t) for x in xs))
    rows = listings.withColumn("expiry_days", F.explode(arr(expiry_days, "int")))
    if moneyness is not None:
        rows = rows.withColumn("moneyness", F.explode(arr(moneyness, "decimal(10,4)")))
        raw, shown, letter = (F.col("spot").cast("decimal(24,8)") * F.col("moneyness")).cast("decimal(30,10)"), F.col("moneyness"), "M"
    else:
        rows = rows.withColumn("given_strike", F.explode(arr(strikes, "decimal(24,8)"))).withColumn("moneyness", F.lit(None).cast("decimal(10,4)"))
        raw, shown, letter = F.col("given_strike").cast("decimal(30,10)"), F.col("given_strike"), "K"
    rows = rows.withColumn("call_put", F.explode(F.array(F.lit("call"), F.lit("put"))))
    strike = tick(raw, increment)
    token = moneyness_column(shown, letter)
    rows = rows.withColumn("strike", strike).withColumn("expiry", following(F.date_add("listing_date", F.col("expiry_days"))))
    template = F.concat(F.lpad(F.col("expiry_days").cast("string"), 4, "0"), F.lit("D-"), token, F.lit("-"), F.upper(F.substring("call_put", 1, 1)))
    rows = rows.withColumn("option_id", F.concat_ws("-", "underlying_id", template))
    return rows.drop("given_strike").withColumn("contract_multiplier", F.lit(multiplier).cast("decimal(24,8)"))


def collapsed_strikes(contracts: DataFrame) -> DataFrame:
    """Contracts that rounding made equal; a sound chain has none."""
    return contracts.groupBy("underlying_id", "expiry", "strike", "call_put").agg(F.count("*").alias("n")).where("n > 1")


def liquid(contracts: DataFrame, longest_days: int = 180, low: str = "0.85", high: str = "1.15") -> DataFrame:
    """Contracts inside the inclusive moneyness band and maximum life."""
    return contracts.where((F.col("expiry_days") <= longest_days) & F.col("moneyness").between(F.lit(low).cast("decimal(10,4)"), F.lit(high).cast("decimal(10,4)")))


def live(date: Column, expiry: Column) -> Column:
    """A contract is quoted before its expiry day only."""
    return date < expiry


def expected_quotes(daily: DataFrame, contracts: DataFrame) -> DataFrame:
    """Contract and date pairs that must have a quote: an equi-join on the
    underlying with the live condition inside. Both sides grow with the market,
    so neither is broadcast."""
    return daily.join(merged(contracts), "underlying_id").where(live(F.col("date"), F.col("expiry")))


def nearest_to_forward(options: DataFrame, *, entity: str = "underlying_id", expiries: int = 2, strikes: int = 5) -> DataFrame:
    """Per entity the earliest expiries, and in each the strikes with the
    smallest distance |ln(K / F)| to the forward; ties go to the lower strike.

    Ranks are filtered in the plan, so partial top-k limits cut each group
    before the shuffle.
    """
    by_expiry = Window.partitionBy(entity).orderBy("expiry")
    early = options.withColumn("__e", F.dense_rank().over(by_expiry)).where(F.col("__e") <= expiries)
    by_strike = Window.partitionBy(entity, "expiry").orderBy(F.abs(F.ln(F.col("strike") / F.col("forward"))), "strike")
    return early.withColumn("__k", F.dense_rank().over(by_strike)).where(F.col("__k") <= strikes).drop("__e", "__k")


def canonical_order(df: DataFrame, *, sides_per_key: bool = True) -> DataFrame:
    """Rows in (date, underlying, expiry, strike, side, option) order."""
    keys = ["date", "underlying_id", "expiry", "strike", "call_put", "option_id"]
    return df.orderBy(*(k for k in keys if k in df.columns))


def with_row_ids(df: DataFrame, *order: str) -> DataFrame:
    """row_000001 ... in the given order, which must be total."""
    numbered = with_positions(df, *order, out="__position")
    return numbered.select(*df.columns, F.format_string("row_%06d", F.col("__position") + 1).alias("row_id"))
