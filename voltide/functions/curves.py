"""Piecewise-linear curves: values, exact interval averages, log moments.

Nodes are (offset in years, value) with ascending offsets; beyond the ends a
curve is flat.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Nodes = list[tuple[float, float]]


def value(nodes: Nodes, t: float) -> float:
    if not nodes:
        raise ValueError("a curve needs nodes")
    if t <= nodes[0][0]:
        return nodes[0][1]
    for (a, x), (b, y) in zip(nodes, nodes[1:], strict=False):
        if t <= b:
            return x + (y - x) * (t - a) / (b - a)
    return nodes[-1][1]


def _cuts(start: float, end: float, *curves: Nodes) -> list[float]:
    inner = {t for c in curves for t, _ in c if start < t < end}
    return sorted({start, end, *inner})


def integral(nodes: Nodes, start: float, end: float) -> float:
    """Of the curve: each linear piece by its trapezoid."""
    cuts = _cuts(start, end, nodes)
    return math.fsum((b - a) * (value(nodes, a) + value(nodes, b)) / 2.0 for a, b in zip(cuts, cuts[1:], strict=False))


def integral_of_square(nodes: Nodes, start: float, end: float) -> float:
    """Of the curve's square: (x*x + x*y + y*y) / 3 on each piece."""
    cuts = _cuts(start, end, nodes)
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        x, y = value(nodes, a), value(nodes, b)
        out.append((b - a) * (x * x + x * y + y * y) / 3.0)
    return math.fsum(out)


def average(nodes: Nodes, start: float, end: float) -> float:
    return value(nodes, start) if start == end else integral(nodes, start, end) / (end - start)


def root_mean_square(nodes: Nodes, start: float, end: float) -> float:
    return abs(value(nodes, start)) if start == end else math.sqrt(integral_of_square(nodes, start, end) / (end - start))


def log_moments(drift: Nodes, vol: Nodes, start: float, end: float) -> tuple[float, float]:
    """Mean and variance of the log return over the interval."""
    v = integral_of_square(vol, start, end)
    return integral(drift, start, end) - 0.5 * v, v


def value_column(nodes: Nodes, t: Column) -> Column:
    """Column form of ``value``: a chain of CASE branches."""
    out = F.when(t <= nodes[0][0], F.lit(float(nodes[0][1])))
    for (a, x), (b, y) in zip(nodes, nodes[1:], strict=False):
        out = out.when(t <= b, F.lit(float(x)) + F.lit(float(y - x)) * (t - a) / F.lit(float(b - a)))
    return out.otherwise(F.lit(float(nodes[-1][1])))


def integral_column(nodes: Nodes, start: Column, end: Column) -> Column:
    """Column form of ``integral``: the sum over pieces of each overlap."""
    pieces = []
    first, last = nodes[0], nodes[-1]
    clip = lambda x, lo, hi: F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))
    pieces.append(F.greatest(F.lit(0.0), F.least(end, F.lit(float(first[0]))) - start) * float(first[1]))
    for (a, x), (b, y) in zip(nodes, nodes[1:], strict=False):
        lo, hi = clip(start, a, b), clip(end, a, b)
        at = lambda t, a=a, x=x, b=b, y=y: F.lit(float(x)) + F.lit(float((y - x) / (b - a))) * (t - float(a))
        pieces.append((hi - lo) * (at(lo) + at(hi)) / 2.0)
    pieces.append(F.greatest(F.lit(0.0), end - F.greatest(start, F.lit(float(last[0])))) * float(last[1]))
    return sum(pieces[1:], pieces[0])


def _pieces(nodes: Nodes, start: Column, end: Column, value) -> Column:
    """The sum over linear pieces, flat ends included, of ``value(width, x, y)``
    with the curve's values at both ends of each overlap."""
    first, last = nodes[0], nodes[-1]
    clip = lambda x, lo, hi: F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))
    flat = lambda v: F.lit(float(v))
    out = value(F.greatest(F.lit(0.0), F.least(end, F.lit(float(first[0]))) - start), flat(first[1]), flat(first[1]))
    for (a, x), (b, y) in zip(nodes, nodes[1:], strict=False):
        lo, hi = clip(start, a, b), clip(end, a, b)
        at = lambda t, a=a, x=x, b=b, y=y: F.lit(float(x)) + F.lit(float((y - x) / (b - a))) * (t - float(a))
        out = out + value(hi - lo, at(lo), at(hi))
    return out + value(F.greatest(F.lit(0.0), end - F.greatest(start, F.lit(float(last[0])))), flat(last[1]), flat(last[1]))


def square_column(nodes: Nodes, start: Column, end: Column) -> Column:
    """Column form of ``integral_of_square``."""
    return _pieces(nodes, start, end, lambda w, x, y: w * (x * x + x * y + y * y) / 3.0)


def rms_column(nodes: Nodes, start: Column, end: Column) -> Column:
    """Column form of ``root_mean_square``."""
    return F.when(start == end, F.abs(value_column(nodes, start))).otherwise(F.sqrt(square_column(nodes, start, end) / F.nullif(end - start, F.lit(0.0))))


def log_moments_columns(drift: Nodes, vol: Nodes, start: Column, end: Column) -> tuple[Column, Column]:
    """Column form of ``log_moments``."""
    v = square_column(vol, start, end)
    return integral_column(drift, start, end) - 0.5 * v, v
