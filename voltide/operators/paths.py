"""Deterministic underlying paths and daily observations.

A path is sequential, since each close is rounded to the tick before the next
step; so days are made one after the other, names side by side. Draws are keyed
by name and date, so a path continued from its last close equals the path made
at once.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltide.functions import curves, rng
from voltide.functions.canonical import clip_int64, quantise_all_to_increment, quantise_to_increment, to_decimal

DAILY = "underlying_id string, date date, spot_open decimal(24,8), spot_high decimal(24,8), spot_low decimal(24,8), spot_close decimal(24,8), volume bigint"


# The names that open each kind of draw's key.
SIMULATION, FACTOR, OWN, INCREMENT, RANGE, VOLUME = "underlying-simulation", "factor", "idiosyncratic", "increment", "underlying-range", "underlying-volume"


#: Names whose paths are made together.
TOGETHER = 256
#: Draws of such names that are made at once, for as many days as they are.
DRAWS = 1 << 18


@dataclass(frozen=True)
class MarketSpec:
    """What a snapshot's paths depend on."""

    snapshot_id: str = "SNAP-1"
    seed: int = 20240101
    measure: str = "P"
    dependence_id: str = "dependence-1"
    loadings: dict[str, tuple[float, ...]] = field(default_factory=lambda: {"A": (0.8,), "B": (0.5,)})
    spots: dict[str, str] = field(default_factory=lambda: {"A": "100", "B": "50"})
    drift: tuple[tuple[float, float], ...] = ((0.0, 0.05), (1.0, 0.03))
    vol: tuple[tuple[float, float], ...] = ((0.0, 0.2), (1.0, 0.3))
    increment: str = "0.01"
    bridge_name: str = "intraday-bridge"
    bridge_id: str = "bridge-1"
    bridge_steps: int = 64
    volume_name: str = "volume-model"
    volume_id: str = "volume-1"
    base_volume: float = 1_000_000.0
    volume_stddev: float = 0.1435941754


def shock(spec: MarketSpec, name: str, day: str) -> float:
    """Common factors weighted by loadings, plus the asset's own part."""
    key = (spec.snapshot_id, spec.seed, SIMULATION, spec.measure, spec.dependence_id)
    return shock_of(name, spec.loadings[name], [rng.gaussian(*key, FACTOR, k, day) for k in range(len(spec.loadings[name]))], rng.gaussian(*key, OWN, name, day))


def shock_of(name: str, load: Sequence[float], factors: Sequence[float], own: float) -> float:
    return math.fsum(map(operator.mul, load, factors)) + own_part(name, load) * own


def own_part(name: str, load: Sequence[float]) -> float:
    """The weight of the asset's own draw."""
    rest = 1.0 - math.fsum(w * w for w in load)
    if rest < -1e-12:
        raise ValueError(f"loadings of {name} are longer than one")
    return math.sqrt(max(rest, 0.0))


@functools.lru_cache(maxsize=65_536)
def _moments(drift: tuple, vol: tuple, start: float, end: float) -> tuple[float, float]:
    return curves.log_moments(list(drift), list(vol), start, end)


def next_close(spec: MarketSpec, close: Decimal, start: float, end: float, eps: float) -> Decimal:
    """One step of geometric Brownian motion, rounded to the tick."""
    return next_closes(spec, [close], start, end, [eps])[0]


def next_closes(spec: MarketSpec, closes: Sequence[Decimal], start: float, end: float, eps: Sequence[float]) -> list[Decimal]:
    """``next_close`` of many names over one day."""
    m, v = _moments(spec.drift, spec.vol, start, end)
    sd, least = math.sqrt(v), Decimal(spec.increment)
    return [max(x, least) for x in quantise_all_to_increment([float(c) * math.exp(m + sd * e) for c, e in zip(closes, eps, strict=True)], spec.increment)]


@functools.lru_cache(maxsize=1024)
def _clocks(drift: tuple, vol: tuple, start: float, end: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the log price at each step; equal for all names."""
    moments = [(0.0, 0.0)] + [curves.log_moments(list(drift), list(vol), start, start + k / n * (end - start)) for k in range(1, n + 1)]
    mean, var = (np.array(x) for x in zip(*moments, strict=True))
    if var[-1] <= 0 or (np.diff(var) < -1e-15).any():
        raise ValueError("the variance of a bridge must grow")
    return mean, var


def bridge_path(spec: MarketSpec, opening: Decimal, close: Decimal, start: float, end: float, z: np.ndarray) -> np.ndarray:
    """A log-price bridge from open to close, ends left out: along the path the
    diffusion's mean would take, with what the close was off spread on the clock
    of integrated variance, and increments ``z`` on that clock."""
    return bridge_paths(spec, [opening], [close], start, end, z[None])[0]


def bridge_paths(spec: MarketSpec, openings: Sequence[Decimal], closes: Sequence[Decimal], start: float, end: float, z: np.ndarray) -> np.ndarray:
    """``bridge_path`` of many names over one day, a row each."""
    mean, var = _clocks(spec.drift, spec.vol, start, end, spec.bridge_steps)
    logs = lambda xs: np.array([math.log(float(x)) for x in xs])[:, None]
    walk = np.zeros((len(z), len(var)))
    np.cumsum(z * np.sqrt(np.maximum(np.diff(var), 0.0)), axis=1, out=walk[:, 1:])
    share, a = var / var[-1], logs(openings)
    off = logs(closes) - a - mean[-1]
    return np.exp(a + mean + share * off + walk - share * walk[:, -1:])[:, 1:-1]


def bridge_draws(spec: MarketSpec, names: Sequence[str], days: Sequence[str]) -> np.ndarray:
    """The increments by day and name, each by a key of its own."""
    head = f"{spec.snapshot_id}|{spec.seed}|{spec.bridge_name}|{spec.bridge_id}|{INCREMENT}|"
    seeds = rng.suffix_seeds([f"{head}{day}|{name}|" for day in days for name in names], [str(k) for k in range(1, spec.bridge_steps + 1)])
    return rng.gaussians_of(seeds).reshape(len(days), len(names), spec.bridge_steps)


def bridge_prices(spec: MarketSpec, name: str, day: str, opening: Decimal, close: Decimal, start: float, end: float) -> list[Decimal]:
    """All prices of a day's bridge on the tick, ends included."""
    path = bridge_path(spec, opening, close, start, end, bridge_draws(spec, [name], [day])[0, 0])
    return [opening, *(quantise_to_increment(float(x), spec.increment) for x in path), close]


def volume(spec: MarketSpec, name: str, day: str) -> int:
    """Mean-preserving lognormal count."""
    z = rng.gaussian(spec.snapshot_id, spec.seed, spec.volume_name, spec.volume_id, day, name)
    return volume_of(spec.base_volume, spec.volume_stddev, z)


def volume_of(base: float, stddev: float, z: float) -> int:
    log = math.log(base) + stddev * z - 0.5 * stddev * stddev
    return clip_int64(math.exp(log) if log < 700 else math.inf)


def legacy_range(opening: Decimal, close: Decimal, vol: float, years: float, z: float, increment: str) -> tuple[Decimal, Decimal]:
    """High and low as a widening of the open-close range by a quarter of a
    random number of standard deviations, one tick at least."""
    wide = vol * math.sqrt(years) * abs(z) * 0.25
    top, bottom = max(opening, close) * to_decimal(1.0 + wide), min(opening, close) * to_decimal(max(0.0, 1.0 - wide))
    return quantise_to_increment(top, increment), quantise_to_increment(max(Decimal(increment), bottom), increment)


def legacy_volume(u: float) -> int:
    """A uniform count around a million."""
    return 750_000 + int(u * 500_000)


def make_paths(spark: SparkSession, spec: MarketSpec, days: Sequence[str], closes: DataFrame | None = None, underlyings: DataFrame | None = None) -> DataFrame:
    """Daily rows of every underlying over ``days`` (ascending ISO dates).

    ``closes`` (underlying_id, date, spot_close): rows already made; only later
    days are added. A day before the last known close is an error.

    ``underlyings`` (underlying_id, spot string, loading array of doubles): taken
    in place of the specification's names, spots and loadings.
    """
    if list(days) != sorted(set(days)):
        raise ValueError("days must ascend")
    if underlyings is None:
        names = spark.createDataFrame([(n, s, list(map(float, spec.loadings[n]))) for n, s in sorted(spec.spots.items())], "underlying_id string, spot string, loading array<double>")
    else:
        names = underlyings.select("underlying_id", "spot", "loading")
    if closes is not None:
        last = closes.groupBy("underlying_id").agg(F.max("date").alias("last_date"), F.max_by("spot_close", "date").alias("last_close"), F.min("date").alias("first_date"))
        early = last.where(F.lit(days[0]).cast("date") <= F.col("last_date")).count() if days else 0
        if early:
            raise ValueError("days at or before the last close can't be filled in")
        names = names.join(last, "underlying_id", "left")
    else:
        names = names.select("*", *(F.lit(None).cast(t).alias(n) for n, t in (("last_date", "date"), ("last_close", "decimal(24,8)"), ("first_date", "date"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # Names with the same days behind them have the same clocks.
            groups: dict[tuple[str, str], list[int]] = {}
            for i, dates in enumerate(zip(b["first_date"], b["last_date"], strict=True)):
                groups.setdefault(tuple(map(str, dates)), []).append(i)
            for at in (g[lo : lo + TOGETHER] for g in groups.values() for lo in range(0, len(g), TOGETHER)):
                yield from _daily_rows(spec, days, b.iloc[at])

    # Names are dealt to all cores, in a number of parts that adaptive execution keeps: a few bytes of a name are some
    # hundred draws. A name that is repeated has one path.
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rest = [c for c in names.columns if c != "underlying_id"]
    one = names.repartition(parts, "underlying_id").groupBy("underlying_id").agg(F.min(F.struct(*rest)).alias("r"))
    return one.select("underlying_id", "r.*").mapInPandas(run, DAILY)


def _daily_rows(spec: MarketSpec, days: Sequence[str], b: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows of some names with the same first and last date: the draws of some
    days are made at once for all names, then days one after the other."""
    names, loads = b["underlying_id"].tolist(), [tuple(map(float, x)) for x in b["loading"]]
    r = b.iloc[0]
    known = r["last_date"] is not None and not pd.isna(r["last_date"])
    closes = [Decimal(str(x)) for x in b["last_close"]] if known else [Decimal(x) for x in b["spot"]]
    origin, before = (pd.Timestamp(r["first_date"]), pd.Timestamp(r["last_date"])) if known else (pd.Timestamp(days[0]) if days else None, None)
    key = f"{spec.snapshot_id}|{spec.seed}"
    common = f"{key}|{SIMULATION}|{spec.measure}|{spec.dependence_id}"
    rests = [own_part(n, w) for n, w in zip(names, loads, strict=True)] if known or len(days) > 1 else []
    some = max(1, DRAWS // (len(names) * (spec.bridge_steps + 2)))
    for block in (days[lo : lo + some] for lo in range(0, len(days), some)):
        moved = block if before is not None else block[1:]
        keys = [f"{common}|{OWN}|{name}|{day}" for day in moved for name in names] + [f"{key}|{spec.volume_name}|{spec.volume_id}|{day}|{name}" for day in block for name in names]
        z = rng.gaussians_of(rng.text_seeds(keys)).reshape(-1, len(names)).tolist()
        own, walks = iter(z[: len(moved)]), iter(bridge_draws(spec, names, moved))
        rows: list[list] = [[] for _ in DAILY.split(", ")]
        for day, noise in zip(block, z[len(moved) :], strict=True):
            t = pd.Timestamp(day)
            openings = closes
            if before is not None:
                start, end = (before - origin).days / 365.0, (t - origin).days / 365.0
                factors = [rng.gaussian(common, FACTOR, k, day) for k in range(max(map(len, loads)))]
                eps = [math.fsum(map(operator.mul, w, factors)) + rest * e for w, rest, e in zip(loads, rests, next(own), strict=True)]
                closes = next_closes(spec, closes, start, end, eps)
                paths = bridge_paths(spec, openings, closes, start, end, next(walks))
                # Rounding keeps the order, so the extremes alone are rounded.
                ends = [quantise_all_to_increment(f(axis=1), spec.increment) for f in (paths.max, paths.min)] if paths.shape[1] else []
                highs, lows = ([f(x) for x in zip(openings, closes, *ends, strict=True)] for f in (max, min))
            else:
                openings = highs = lows = closes = [quantise_to_increment(c, spec.increment) for c in closes]
            volumes = [volume_of(spec.base_volume, spec.volume_stddev, x) for x in noise]
            for column, values in zip(rows, (names, [t.date()] * len(names), openings, highs, lows, closes, volumes), strict=True):
                column += values
            before = t
        yield pd.DataFrame(dict(zip((x.split()[0] for x in DAILY.split(", ")), rows, strict=True)))
