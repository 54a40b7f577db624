"""Column helpers for the missing-value rules every operator follows.

Missing is NULL only: NaN and the infinities become NULL on entry, a division
by zero is NULL, and a 0/1 flag is never NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def flag(condition: Column) -> Column:
    return F.coalesce(condition.cast("int"), F.lit(0))


def finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def all_present(*columns: Column) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])


def strict_greatest(*columns: Column) -> Column:
    """Greatest value, NULL as soon as one input is NULL."""
    return F.when(all_present(*columns), F.greatest(*columns))


def strict_least(*columns: Column) -> Column:
    return F.when(all_present(*columns), F.least(*columns))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def sorted_quantile(ordered: Column, q: float, n: int) -> Column:
    """Linear-interpolated quantile of a sorted array of known length."""
    place = q * (n - 1)
    low = int(place)
    part = place - low
    first = F.get(ordered, F.lit(low))
    if part == 0:
        return first
    return first + (F.get(ordered, F.lit(low + 1)) - first) * part

