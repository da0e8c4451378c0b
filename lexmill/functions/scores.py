"""Scores, rounding and finance as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """floor(x * f + 0.5) / f: halves go up, also below zero."""
    f = 10.0**digits
    return F.floor(x * f + 0.5) / f


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is missing or zero, or the lengths differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), clamp(dot(a, b) / norm, -1.0, 1.0))


def weighted(parts: dict[str, tuple[Column, float]]) -> Column:
    """Sum of weight times component, halves up to one decimal."""
    total = None
    for value, weight in parts.values():
        total = value * weight if total is None else total + value * weight
    return half_up(total, 1)


def ladder(score: Column, steps: tuple[tuple[float, str], ...], otherwise: str) -> Column:
    """The label of the first threshold reached."""
    out = None
    for least, label in steps:
        out = F.when(score >= least, label) if out is None else out.when(score >= least, label)
    return out.otherwise(otherwise)


def present_value(flows: Column, rate: float) -> Column:
    """Flows at times 0, 1, 2, ... discounted at a rate."""
    return F.aggregate(
        F.transform(flows, lambda x, i: x / F.pow(F.lit(1.0 + rate), i)), F.lit(0.0), lambda s, x: s + x
    )


def discounted(flows: Column, rate: Column) -> Column:
    """Flows at times 0, 1, 2, ... at a rate that is a column: from the last one back, without powers."""
    return F.aggregate(F.reverse(flows), F.lit(0.0), lambda s, x: s / (1 + rate) + x.cast("double"))


def rate_of_return(flows: Column, low: float = -0.99, high: float = 5.0, rounds: int = 200) -> Column:
    """The rate at which the flows are worth nothing, by bisection; null where their worth at both ends has
    one sign, so no root lies between them for certain, and for fewer than two flows."""
    ends = [discounted(flows, F.lit(r)) for r in (low, high)]
    start = F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["low"] + s["high"]) / 2
        # the worth has the sign that it has at the lower end: the root lies above
        above = (discounted(flows, mid) > 0) == (ends[0] > 0)
        return F.struct(F.when(above, mid).otherwise(s["low"]).alias("low"), F.when(above, s["high"]).otherwise(mid).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve, lambda s: (s["low"] + s["high"]) / 2)
    return F.when((F.size(flows) > 1) & (ends[0] * ends[1] < 0), found)


def payback(flows: Column) -> Column:
    """The time at which the sum of the flows reaches zero, interpolated within a period; null if it never does."""
    state = F.struct(F.lit(-1).alias("at"), F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("found"))

    def add(s: Column, x: Column) -> Column:
        x = x.cast("double")
        total = s["sum"] + x
        crossed = s["found"].isNull() & (s["at"] >= 0) & (total >= 0)
        found = F.when(crossed, s["at"] + F.coalesce(F.try_divide(-s["sum"], x), F.lit(0.0))).otherwise(s["found"])
        return F.struct((s["at"] + 1).alias("at"), total.alias("sum"), found.alias("found"))

    return F.aggregate(flows, state, add, lambda s: s["found"])


def backoff_seconds(attempt: Column, base: int, most: int = 86_400) -> Column:
    """Doubling delays from the second attempt on."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0)))).cast("long")
