"""Numeric functions; those of whole columns take the window they look at."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NaN and the infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def safe_ratio(a: Column, b: Column, default: float | None = None) -> Column:
    r = F.try_divide(a, b)
    return r if default is None else F.coalesce(r, F.lit(default))


def clipped(c: Column, low, high) -> Column:
    """Null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high) if not isinstance(high, Column) else high), F.lit(low) if not isinstance(low, Column) else low))


def z_score(c: Column, over: WindowSpec) -> Column:
    return F.try_divide(c - F.avg(c).over(over), F.stddev_samp(c).over(over))


def min_max(c: Column, over: WindowSpec, constant: float = 0.5) -> Column:
    """0 to 1 within the window; where all values are equal, `constant`."""
    low, high = F.min(c).over(over), F.max(c).over(over)
    return F.when(c.isNull(), None).when(high == low, constant).otherwise((c - low) / (high - low))


def fixed_range(c: Column, low: float, high: float) -> Column:
    return clipped((c - low) / (high - low), 0.0, 1.0)


def bayesian_average(rating: Column, votes: Column, prior: Column | float, weight: float = 2500) -> Column:
    prior = prior if isinstance(prior, Column) else F.lit(prior)
    return (votes * rating + weight * prior) / (votes + weight)


def weighted_composite(parts: Sequence[tuple[Column, float]], renormalise: bool = False) -> Column:
    """Weighted sum; a missing part counts 0, with the full weight below unless `renormalise`."""
    total = sum(w for _, w in parts)
    top = sum((F.coalesce(c, F.lit(0.0)) * w for c, w in parts), F.lit(0.0))
    if not renormalise:
        return top / total
    below = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return F.try_divide(top, below)


def binned(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins (a, b]; outside all of them null."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels, strict=False))):
        out = F.when((c > low) & (c <= high), label).otherwise(out)
    return out


def cohort(c: Column, limits: Sequence[tuple[float, str]], rest: str) -> Column:
    """The label of the first limit not exceeded; null is null."""
    out = F.lit(rest)
    for limit, label in reversed(limits):
        out = F.when(c <= limit, label).otherwise(out)
    return F.when(c.isNotNull(), out)


def softmax(c: Column, over: WindowSpec, temperature: float = 1.0) -> Column:
    """Shares of exp(c / temperature); the maximum is taken off first, so nothing overflows."""
    e = F.exp((c - F.max(c).over(over)) / temperature)
    return e / F.sum(e).over(over)


def implied_probability(odds: Column) -> Column:
    return F.when(odds > 1, 1 / odds)


def elo_expectation(mine: Column, other: Column, home: float = 0.0) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (other - mine - home) / 400))
