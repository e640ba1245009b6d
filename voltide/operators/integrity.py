"""Gates, differences and digests of tables."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltide.operators import chain
from voltide.session import merged


class GateError(ValueError):
    """Some gates failed; ``failures`` has their counts."""

    def __init__(self, failures: dict[str, int]):
        super().__init__(f"gates failed: {failures}")
        self.failures = failures


def run_gates(gates: dict[str, DataFrame]) -> dict[str, int]:
    """Count each gate's offending rows, all in one job; raise if any."""
    parts = [df.select(F.lit(name).alias("gate")) for name, df in gates.items()]
    counts = dict.fromkeys(gates, 0)
    if parts:
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        counts |= {r.gate: r["count"] for r in every.groupBy("gate").count().collect()}
    if failures := {k: n for k, n in counts.items() if n}:
        raise GateError(failures)
    return counts


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Child rows without a parent; null keys are orphans."""
    return child.join(merged(parent.select(*keys).distinct()), list(keys), "left_anti")


def mismatches(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Joined rows that differ in some column, nulls compared as values."""
    renamed = right.select(*keys, *(F.col(x).alias(f"__{x}") for x in columns))
    differs = F.lit(False)
    for x in columns:
        differs = differs | ~F.col(x).eqNullSafe(F.col(f"__{x}"))
    return left.join(merged(renamed), list(keys)).where(differs).select(*left.columns)


def incomplete_sets(df: DataFrame, keys: Sequence[str], column: str, wanted: Sequence) -> DataFrame:
    """Groups whose set of values is not exactly the wanted one."""
    want = F.sort_array(F.array(*map(F.lit, sorted(wanted))))
    return df.groupBy(*keys).agg(F.sort_array(F.collect_set(column)).alias("found")).where(F.col("found") != want)


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_rows(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected keys that the actual table lacks."""
    return expected.select(*keys).join(merged(actual.select(*keys)), list(keys), "left_anti")


def parity_gap(options: DataFrame, keys: Sequence[str], spot: str = "spot", tau: str = "tau", rate: str = "rate", q: str = "yield", value: str = "price") -> DataFrame:
    """Put-call parity error of each call and put pair: one grouped pass."""
    side = lambda s: F.max(F.when(F.col("call_put") == s, F.col(value)))
    pairs = options.groupBy(*keys).agg(side("call").alias("call_price"), side("put").alias("put_price"), *(F.max(x).alias(x) for x in (spot, "strike", tau, rate, q) if x not in keys))
    forward = F.col(spot) * F.exp(-F.col(q) * F.col(tau)) - F.col("strike") * F.exp(-F.col(rate) * F.col(tau))
    return pairs.withColumn("gap", F.abs(F.col("call_price") - F.col("put_price") - forward))


def multiset_difference(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that one side has more often, with their multiplicity kept.

    One grouped pass over both sides, which cuts repeats before the shuffle.
    """
    right = right.select(*left.columns)
    tally = left.withColumn("__side", F.lit(1)).unionByName(right.withColumn("__side", F.lit(-1)))
    net = tally.groupBy(*left.columns).agg(F.sum("__side").alias("__net"))
    more = lambda sign: net.where(F.col("__net") * sign > 0).withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__net") * sign))).select(*left.columns)
    return more(1), more(-1)


def replay_difference(left: dict[str, DataFrame], right: dict[str, DataFrame]) -> dict[str, tuple[int, int]]:
    """For each table, how many rows only the left or only the right has."""
    if set(left) != set(right):
        raise ValueError("the table inventories differ")
    out = {}
    for name in sorted(left):
        a, b = multiset_difference(left[name], right[name])
        out[name] = (a.count(), b.count())
    return out


def canonical_row(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """One text per row that differs where any value or type differs."""
    parts = []
    for f in df.select(*(columns or df.columns)).schema.fields:
        x = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            x = F.when(x == 0, F.lit(0.0)).otherwise(x)  # one zero
        text = F.when(F.col(f.name).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), x.cast("string")))
        parts += [F.length(text).cast("string"), F.lit(":"), text]
    return F.concat(*parts)


def multiset_digest(df: DataFrame, columns: Sequence[str] | None = None) -> str:
    """A digest that row order and partitioning don't change: the count and the
    sums of eight slices of each row's SHA-256. Combines before any shuffle."""
    h = F.sha2(F.concat_ws("", canonical_row(df, columns)), 256)
    slices = [F.sum(F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(8)]
    r = df.agg(F.count("*").alias("n"), *slices).first()
    return hashlib.sha256(json.dumps([r.n, *(str(r[f"s{i}"]) for i in range(8))]).encode()).hexdigest()


def ordered_digest(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> str:
    """SHA-256 over canonical rows in a canonical order; repeated keys are an
    error. Rows fall into 4096 buckets by the hash of their key; each bucket's
    row hashes are hashed in key order where they meet, and only the buckets'
    digests, in order, reach the driver."""
    if repeated_keys(df, keys).limit(1).count():
        raise ValueError("repeated keys have no order")
    row, key = canonical_row(df, columns), canonical_row(df, keys)
    rows = df.select(F.sha2(key, 256).alias("k"), F.sha2(row, 256).alias("h"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("k", "h"))), lambda x: x["h"])
    buckets = rows.groupBy(F.substring("k", 1, 3).alias("bucket")).agg(F.sha2(F.array_join(listed, ""), 256).alias("digest"))
    return hashlib.sha256("".join(r.digest for r in sorted(buckets.collect())).encode()).hexdigest()


def content_digest(df: DataFrame, keys: Sequence[str], identity: Sequence[str]) -> str:
    """Ordered digest without identity columns, so that a renamed copy of the
    same market content keeps its digest."""
    return ordered_digest(df.drop(*identity), keys)


def project_identity(df: DataFrame, keys: Sequence[str], changes: dict[str, object]) -> DataFrame:
    """A copy with new identity columns and provably the same content."""
    out = df.withColumns({k: F.lit(v).cast(df.schema[k].dataType) for k, v in changes.items()})
    if content_digest(out, keys, list(changes)) != content_digest(df, keys, list(changes)):
        raise ValueError("the projection changed market content")
    return out


def exact_sum(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The correctly rounded sum of doubles per group, in any row order.

    A double is a whole number of units of a power of two. Values go to slots of
    32 binary places by their exponent; whole numbers of each slot's unit add up
    exactly, and the slots' sums, few a group, are added as fractions once."""
    x = F.col(column)
    slot = F.floor(F.log2(F.abs(x)) / 32).cast("int")
    part = lambda n: x * F.pow(F.lit(2.0), -16.0 * n) * F.pow(F.lit(2.0), -16.0 * n)
    high = F.floor(part(slot)).cast("long")  # of 33 bits at most
    rest = part(slot) - high.cast("double")
    middle = F.floor(rest * float(2**32)).cast("long")
    low = ((rest * float(2**32) - middle.cast("double")) * float(2**32)).cast("long")
    terms = F.array(*(F.struct((slot - i).alias("slot"), v.alias("v")) for i, v in enumerate((high, middle, low))))
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = df.where(x.isNotNull() & (x != 0) & finite)
    sums = usable.select(*keys, F.explode(terms).alias("t")).groupBy(*keys, F.col("t.slot").alias("slot")).agg(F.sum(F.col("t.v").cast("decimal(38,0)")).cast("string").alias("v"))

    def add(slots: pd.Series, values: pd.Series) -> float:
        total = sum((int(v) * Fraction(2) ** (32 * int(k)) for k, v in zip(slots, values, strict=True)), Fraction(0))
        try:
            return float(total)
        except OverflowError:
            return float("inf") if total > 0 else float("-inf")

    exact = F.pandas_udf(lambda s, v: pd.Series([add(a, b) for a, b in zip(s, v, strict=True)]), "double")
    listed = sums.groupBy(*keys).agg(F.collect_list("slot").alias("s"), F.collect_list("v").alias("v"))  # some 70 slots a group at most
    found = listed.select(*keys, exact("s", "v").alias("__sum"))
    every = df.groupBy(*keys).agg(F.count(column).alias("__n"), F.sum(F.when(~finite, x)).alias("__odd"))
    match = F.lit(True)
    for k in keys:
        match = match & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return every.alias("a").join(found.alias("b"), match, "left").select(*(F.col(f"a.{k}") for k in keys), F.when(F.col("__n") > 0, F.coalesce("__odd", "__sum", F.lit(0.0))).alias(f"sum_{column}"))


_NAME = re.compile(r"[^a-z0-9]")


def normal_name(name: str) -> str:
    return _NAME.sub("", name.lower())


def private_fields(schema: T.DataType, private: set[str], path: str = "") -> list[str]:
    """Paths of a schema whose normalised names are private."""
    if isinstance(schema, T.StructType):
        out = []
        for f in schema.fields:
            here = f"{path}.{f.name}" if path else f.name
            out += [here] if normal_name(f.name) in private else []
            out += private_fields(f.dataType, private, here)
        return out
    if isinstance(schema, T.ArrayType):
        return private_fields(schema.elementType, private, f"{path}[]")
    if isinstance(schema, T.MapType):
        return private_fields(schema.valueType, private, f"{path}{{}}")
    return []


def private_in_json(text, names: frozenset[str]) -> bool:
    """Whether a JSON text has a private key at any depth, texts that are JSON
    themselves included."""
    todo = [text]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if any(normal_name(k) in names for k in x):
                return True
            todo += x.values()
        elif isinstance(x, list):
            todo += x
        elif isinstance(x, str) and x.lstrip()[:1] in ("{", "[", '"'):
            try:
                todo.append(json.loads(x, object_pairs_hook=_Pairs))
            except RecursionError:
                return True  # too deep to be sure
            except ValueError:
                continue
        elif isinstance(x, _Pairs):
            if any(normal_name(k) in names for k, _ in x.pairs):
                return True
            todo += [v for _, v in x.pairs]
    return False


class _Pairs:
    """An object's keys and values, repeated keys too."""

    def __init__(self, pairs):
        self.pairs = pairs


def private_json_rows(df: DataFrame, columns: Sequence[str], private: Sequence[str]) -> DataFrame:
    """Rows whose JSON texts have a private key at any depth; the JSON is read,
    so no spelling of a key passes."""
    names = frozenset(map(normal_name, private))
    hits = F.pandas_udf(lambda s: s.map(lambda x: private_in_json(x, names)), "boolean")
    hit = F.lit(False)
    for x in columns:
        hit = hit | hits(F.col(x).cast("string"))
    return df.where(hit)


def assert_compatible(old: DataFrame, new: DataFrame, keys: Sequence[str], what: str) -> None:
    """Definitions that exist must not change; new ones may come."""
    known = new.join(old.select(*keys), list(keys), "left_semi")
    lost, gained = multiset_difference(old, known)
    if lost.limit(1).count() or gained.limit(1).count():
        raise ValueError(f"{what} definitions differ from those already stored")


Gate = Callable[[dict[str, DataFrame]], DataFrame]
#: Gates of a materialised market: name to offending rows.
MARKET_GATES: dict[str, Gate] = {
    "orphan_contract": lambda m: orphans(m["contracts"], m["underlyings"], ["underlying_id"]),
    "orphan_daily": lambda m: orphans(m["daily"], m["underlyings"], ["underlying_id"]),
    "orphan_quote": lambda m: orphans(m["quotes"], m["contracts"], ["option_id"]),
    "quote_contract_mismatch": lambda m: mismatches(m["quotes"], m["contracts"], ["option_id"], ["underlying_id", "call_put", "strike", "expiry"]),
    "missing_quote": lambda m: missing_rows(chain.expected_quotes(m["daily"], m["contracts"]), m["quotes"], ["date", "option_id"]),
    "missing_pricing": lambda m: missing_rows(m["daily"], m["pricing"], ["date", "underlying_id"]),
    "bad_ohlc": lambda m: m["daily"].where("not (spot_low <= least(spot_open, spot_close) and spot_high >= greatest(spot_open, spot_close) and volume >= 0)"),
    "crossed_quote": lambda m: m["quotes"].where("bid > ask or bid < 0"),
    "repeated_quote": lambda m: repeated_keys(m["quotes"], ["date", "option_id"]),
}


def market_gates(market: dict[str, DataFrame], gates: dict[str, Gate] | None = None) -> dict[str, int]:
    """Run the gates; a table that a gate needs and the market lacks fails it."""
    try:
        found = {name: gate(market) for name, gate in (gates or MARKET_GATES).items()}
    except KeyError as missing:
        raise GateError({f"table {missing.args[0]} is missing": 1}) from None
    return run_gates(found)


def observation_replay(daily: DataFrame, again: DataFrame) -> DataFrame:
    """Stored daily rows that differ from those made again by the specification,
    in any of open, high, low, close and volume, or that only one side has."""
    values = ["spot_open", "spot_high", "spot_low", "spot_close", "volume"]
    renamed = again.select("underlying_id", "date", *(F.col(x).alias(f"again_{x}") for x in values), F.lit(1).alias("__again"))
    both = daily.withColumn("__stored", F.lit(1)).join(renamed, ["underlying_id", "date"], "full")
    differs = F.col("__again").isNull() | F.col("__stored").isNull()
    for x in values:
        differs = differs | ~F.col(x).eqNullSafe(F.col(f"again_{x}"))
    return both.where(differs).drop("__again", "__stored")
