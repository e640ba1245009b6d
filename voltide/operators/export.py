"""Task selection, publication gates and public projections."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltide.functions import bsm, rng
from voltide.functions.canonical import near_half_column, stable_id
from voltide.operators import chain, dependence, integrity, selection

#: What a public market may show, by relation.
PUBLIC = {
    "underlying_state": ("date", "underlying_id", "measure", "spot_close"),
    "option_contracts": ("option_id", "underlying_id", "call_put", "strike", "expiry", "contract_multiplier"),
    "option_chain_quotes": ("date", "underlying_id", "option_id", "bid", "ask"),
    "pricing_context": ("date", "underlying_id", "measure", "risk_free_rate", "dividend_yield"),
    "underlying_dependence": ("measure", "driver_i", "driver_j", "rho"),
}


def sample_underlyings(underlyings: DataFrame, n: int, contract: str, seed: int) -> DataFrame:
    """A deterministic sub-universe in id order."""
    return selection.hash_sample(underlyings, n, contract, seed, "underlying_id")


def public_projection(market: dict[str, DataFrame], underlyings: DataFrame, date: str, snapshot: str, private: set[str]) -> dict[str, DataFrame]:
    """A child snapshot of the chosen underlyings at one date: state, live
    contracts, their quotes, pricing inputs, the dependence of the chosen
    drivers under both measures, and one row of metadata. Only public columns
    pass; a private field, a missing state, price context or quote is an error."""
    keep = underlyings.select("underlying_id")
    at = lambda name: market[name].where(F.col("date") == F.lit(date).cast("date")).join(keep, "underlying_id", "left_semi")
    quotes = at("quotes")
    drivers = keep.withColumnRenamed("underlying_id", "driver")
    rho = dependence.submatrix_of(market["loadings"], drivers)
    found = {
        "underlying_state": at("daily").withColumn("measure", F.lit("P")),
        "option_contracts": market["contracts"].join(quotes.select("option_id"), "option_id", "left_semi"),
        "option_chain_quotes": quotes,
        "pricing_context": at("pricing").withColumn("measure", F.lit("Q")),
        "underlying_dependence": rho.withColumn("measure", F.explode(F.array(F.lit("P"), F.lit("Q")))),
    }
    out = {name: df.select(F.lit(snapshot).alias("snapshot_id"), *PUBLIC[name]) for name, df in found.items()}
    for name, df in out.items():
        if hidden := integrity.private_fields(df.schema, private):
            raise ValueError(f"{name} shows private fields {hidden}")
    integrity.run_gates(
        {
            "underlyings_without_state": integrity.missing_rows(keep, out["underlying_state"], ["underlying_id"]),
            "underlyings_without_pricing": integrity.missing_rows(keep, out["pricing_context"], ["underlying_id"]),
            "underlyings_without_quotes": integrity.missing_rows(keep, out["option_chain_quotes"], ["underlying_id"]),
            "repeated_states": integrity.repeated_keys(out["underlying_state"], ["underlying_id"]),
            "repeated_options": integrity.repeated_keys(out["option_chain_quotes"], ["option_id"]),
        }
    )
    counts = {name: df.count() for name, df in out.items()}
    one = [(snapshot, date, *(counts[k] for k in sorted(counts)))]
    out["metadata"] = keep.sparkSession.createDataFrame(one, "snapshot_id string, valuation_date string, " + ", ".join(f"{k} long" for k in sorted(counts)))
    return out


def select_task_rows(options: DataFrame, *, expiries: int = 2, strikes: int = 5) -> DataFrame:
    """Nearest strikes of the earliest expiries of each underlying, both sides,
    numbered in canonical order."""
    chosen = chain.nearest_to_forward(options, expiries=expiries, strikes=strikes)
    return chain.with_row_ids(chosen, "underlying_id", "expiry", "strike", "call_put")


def size_gates(rows: DataFrame, underlyings: int, expiries: int, strikes: int) -> dict[str, int]:
    """Every underlying has all expiries, strikes and both sides."""
    per_expiry = rows.groupBy("underlying_id", "expiry").agg(F.countDistinct("strike").alias("n"))
    return integrity.run_gates(
        {
            "underlyings": rows.agg(F.countDistinct("underlying_id").alias("n")).where(F.col("n") != underlyings),
            "expiries": rows.groupBy("underlying_id").agg(F.countDistinct("expiry").alias("n")).where(F.col("n") != expiries),
            "strikes": per_expiry.where(F.col("n") != strikes),
            "sides": integrity.incomplete_sets(rows, ["underlying_id", "expiry", "strike"], "call_put", ["call", "put"]),
            "row_ids": integrity.repeated_keys(rows, ["row_id"]),
        }
    )


def unpublishable(solved: DataFrame, metrics: Sequence[str], status: str = "iv_status") -> DataFrame:
    """Rows without a root, or with a metric so near a rounding boundary that
    a second implementation might round it apart. Doubles are read through
    their shortest text, in generated code."""
    bad = F.col(status) != bsm.OK
    for m in metrics:
        bad = bad | F.coalesce(near_half_column(F.col(m).cast("double").cast("string").cast("decimal(38,18)")), F.lit(False))
    return solved.where(bad)


def task_id(snapshot_id: str, metric: str, digest: str) -> str:
    return stable_id("task-", {"snapshot": snapshot_id, "metric": metric, "digest": digest})


def sample_nodes(snapshot: str, seed: int, name: str, *, offsets: Sequence[float], n: int, mean: float, spread: float, pull: float, low: float, high: float, log: bool = False) -> list[tuple[float, float]]:
    """A random curve: ``n`` offsets drawn without replacement by priority, and
    a bounded first-order autoregression of values (of logs, with ``log``)."""
    ranked = sorted(offsets, key=lambda x: (rng.uniform(snapshot, seed, name, "offset", x), x))
    chosen = sorted(ranked[:n])
    z = rng.gaussians(len(chosen), snapshot, seed, name, "values")
    centre = np.log(mean) if log else mean
    value, out = centre, []
    for t, e in zip(chosen, z, strict=True):
        value = centre + pull * (value - centre) + spread * e
        shown = float(np.clip(np.exp(value) if log else value, low, high))
        value = float(np.log(shown)) if log else shown
        out.append((float(t), shown))
    return out
