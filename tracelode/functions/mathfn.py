"""Scores on a 0-100 scale, ratios that keep unknown apart from zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def ratio(a: Column, b: Column) -> Column:
    """a / b, at least 0; 0 where b is not positive."""
    return F.when(b <= EPSILON, F.lit(0.0)).otherwise(F.greatest(a / b, F.lit(0.0)))


def cap(c: Column, target: float) -> Column:
    """Percent of a target, 0 to 100."""
    return F.lit(0.0) if target <= EPSILON else clamp(c / F.lit(target) * 100.0)


def inverse(c: Column) -> Column:
    return clamp(F.lit(100.0) - c)


def weighted(*parts: tuple[Column, float]) -> Column:
    total = F.lit(0.0)
    for c, w in parts:
        total = total + clamp(c) * w
    return clamp(total)


def average(*parts: Column) -> Column:
    total = F.lit(0.0)
    for c in parts:
        total = total + c
    return total / len(parts)


def nonnegative(c: Column) -> Column:
    """c, or 0 where it is negative; null stays null, which greatest() would turn into 0."""
    return F.when(c < 0, F.lit(0).cast("long")).otherwise(c)


def saturating_delta(c: Column, before: Column) -> Column:
    return nonnegative(c - before)


def complete_sum(c: Column) -> Column:
    """A sum that is null as soon as one value is: an incomplete cost has no total."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def half_life_weight(age_days: Column, half_life: float = 45.0) -> Column:
    return F.exp(-F.log(F.lit(2.0)) * age_days / half_life)


def tolerant_long(c: Column) -> Column:
    """A non-negative whole number from text or number, else null."""
    v = F.try_to_number(F.trim(c.cast("string")), F.lit("999999999999999999")).cast("long")
    v = F.coalesce(v, c.cast("string").try_cast("double").cast("long"))
    return F.when(v >= 0, v)


def tolerant_double(c: Column) -> Column:
    v = F.trim(c.cast("string")).try_cast("double")
    return F.when((v >= 0) & ~F.isnan(v) & (v < float("inf")), v)
