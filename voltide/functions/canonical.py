"""Exact decimal text, canonical JSON and content ids.

Doubles become decimals through their shortest decimal text, then round half to
even; a negative zero is written without its sign.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
import re
from decimal import ROUND_HALF_EVEN, Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL8 = re.compile(r"-?(0|[1-9][0-9]*)\.[0-9]{8}")


def to_decimal(x) -> Decimal:
    return x if isinstance(x, Decimal) else Decimal(str(x))


def quantise(x, places: int = 8) -> Decimal:
    """Round to ``places`` decimals, half to even, without a negative zero."""
    with localcontext() as ctx:
        ctx.prec = 60
        out = to_decimal(x).quantize(Decimal(1).scaleb(-places), rounding=ROUND_HALF_EVEN)
    return abs(out) if out == 0 else out


def quantise_to_increment(x, increment, places: int = 8) -> Decimal:
    """The nearest multiple of ``increment`` (half to even), then ``places``."""
    step = to_decimal(increment)
    if step <= 0:
        raise ValueError("the increment must be positive")
    with localcontext() as ctx:
        ctx.prec = 60
        n = (to_decimal(x) / step).quantize(Decimal(1), rounding=ROUND_HALF_EVEN)
        return quantise(n * step, places)


def quantise_all_to_increment(xs, increment, places: int = 8) -> list[Decimal]:
    """``quantise_to_increment`` of many doubles: binary division tells the
    multiple of all but those next to a half, which are rounded by themselves."""
    step = to_decimal(increment)
    with localcontext() as ctx:
        ctx.prec = 60
        unit = step.quantize(Decimal(1).scaleb(-places))
        if unit != step or step <= 0:
            return [quantise_to_increment(x, step, places) for x in xs]
        x = np.asarray(xs, float)
        n = x / float(step)
        whole = np.rint(n)
        # Below 1e9 the quotient is off by less than 1e-6.
        sure = (np.abs(n) < 1e9) & (np.abs(n - whole) < 0.5 - 1e-5)
        multiples = np.where(sure, whole, 0.0).astype(np.int64).tolist()
        return [unit * k if ok else quantise_to_increment(v, step, places) for k, ok, v in zip(multiples, sure.tolist(), x.tolist(), strict=True)]


def decimal_text(x, places: int = 8) -> str | None:
    """Fixed-point text; None for null and for values that are not finite."""
    if x is None or (isinstance(x, float) and not math.isfinite(x)):
        return None
    return format(quantise(x, places), "f")


def near_half(x, places: int = 8, tolerance: Decimal = Decimal("1e-11")) -> bool:
    """Whether a value is so close to a rounding boundary that two
    implementations might round it apart."""
    with localcontext() as ctx:
        ctx.prec = 60
        scaled = to_decimal(x).scaleb(places)
        rest = abs(scaled - scaled.to_integral_value(rounding="ROUND_FLOOR") - Decimal("0.5"))
        return rest <= tolerance.scaleb(places)


def canonical_json(value) -> str:
    """Sorted keys, no spaces, UTF-8 as it is, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def tagged(x):
    """A scalar with its type where JSON would lose it."""
    if isinstance(x, Decimal):
        return {"decimal": format(x, "f")}
    if isinstance(x, bool) or x is None or isinstance(x, (int, str)):
        return x
    if isinstance(x, float):
        if not math.isfinite(x):
            raise ValueError("a canonical number must be finite")
        return {"float64": format(x, ".17g")}
    if isinstance(x, dt.datetime):
        x = x if x.tzinfo is None else x.astimezone(dt.timezone.utc)
        return {"datetime": x.isoformat(timespec="microseconds")}
    if isinstance(x, dt.date):
        return {"date": x.isoformat()}
    raise TypeError(f"no canonical form for {type(x).__name__}")


def tagged_json(text: str | None):
    """A JSON document with its numbers tagged where their text would not do."""

    def walk(x):
        if isinstance(x, dict):
            return {k: walk(v) for k, v in x.items()}
        return [walk(v) for v in x] if isinstance(x, list) else tagged(x)

    return None if text is None else {"json": walk(json.loads(text))}


def tagged_column(x: Column) -> Column:
    """Canonical JSON of ``tagged`` for a column of any scalar type, in Arrow
    batches; nulls are the text null."""
    text = F.arrow_udf(lambda a: pa.array([canonical_json(tagged(v)) for v in a.to_pylist()], pa.string()), "string")
    return text(x)


def moneyness_column(x: Column, letter: str = "M") -> Column:
    """Column form of ``moneyness_token`` for decimals, without trailing zeros."""
    short = F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.concat(F.lit(letter), F.replace(F.replace(short, F.lit("-"), F.lit("m")), F.lit("."), F.lit("p")))


def near_half_column(x: Column, places: int = 8, tolerance: str = "0.00000000001") -> Column:
    """Column form of ``near_half`` for decimals of 18 places at most."""
    scaled = x.cast("decimal(38,18)") * F.lit(Decimal(10) ** places).cast("decimal(19,0)")
    rest = F.abs(scaled - F.floor(scaled).cast("decimal(38,0)") - F.lit(Decimal("0.5")))
    return rest <= F.lit(Decimal(tolerance) * Decimal(10) ** places)


def decimal_column(x: Column, places: int = 8) -> Column:
    """Column form of ``decimal_text`` for doubles, in generated code: through
    the shortest text, as exact decimals, half to even."""
    finite = ~F.isnan(x) & (F.abs(x) < 1e19)
    exact = F.when(finite, x).cast("string").cast("decimal(38,18)")
    return F.bround(exact, places).cast(f"decimal(38,{places})").cast("string")


def stable_id(prefix: str, parts: dict, digits: int = 24) -> str:
    """A content id: the prefix and the first hex digits of a SHA-256."""
    return prefix + hashlib.sha256(canonical_json(parts).encode()).hexdigest()[:digits]


def stable_id_column(prefix: str, digits: int = 24, **parts: Column) -> Column:
    """Column form of ``stable_id`` for texts and whole numbers: canonical JSON
    with sorted keys, made and hashed in generated code."""
    doc = F.to_json(F.struct(*(parts[k].alias(k) for k in sorted(parts))), {"ignoreNullFields": "false"})
    return F.concat(F.lit(prefix), F.substring(F.sha2(doc, 256), 1, digits))


def tick(x: Column, increment: str, places: int = 8) -> Column:
    """Column form of ``quantise_to_increment`` for decimal columns."""
    step = F.lit(Decimal(increment))
    return (F.bround((x / step).cast("decimal(38,10)"), 0).cast("decimal(20,0)") * step).cast(f"decimal(24,{places})")


def round_even(x: Column, places: int = 8) -> Column:
    """Half-even rounding of a decimal column."""
    return F.bround(x.cast("decimal(38,18)"), places).cast(f"decimal(24,{places})")


def moneyness_token(x) -> str:
    """0.95 as ``M0p95``."""
    return "M" + format(to_decimal(x), "f").replace("-", "m").replace(".", "p")


def clip_int64(x: float) -> int:
    """Round half to even into the range of a signed 64-bit integer."""
    if math.isnan(x):
        raise ValueError("not a number")
    top = 2**63 - 1
    if x >= float(top):
        return top
    if x <= -float(2**63):
        return -(2**63)
    return round(x)
