"""Rolling statistics over trailing rows, missing until a window is full."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.numeric import ratio, sorted_quantile
from tickloom.operators.series import Frames


def rolling(f: Frames, agg: Callable[[str], Column], x: str, n: int) -> Column:
    return F.when(f.full(x, n), agg(x).over(f.last(n)))


def mean(f: Frames, x: str, n: int) -> Column:
    return rolling(f, F.avg, x, n)


def total(f: Frames, x: str, n: int) -> Column:
    return rolling(f, F.sum, x, n)


def deviation(f: Frames, x: str, n: int) -> Column:
    return rolling(f, F.stddev_samp, x, n)


def lowest(f: Frames, x: str, n: int) -> Column:
    return rolling(f, F.min, x, n)


def highest(f: Frames, x: str, n: int) -> Column:
    return rolling(f, F.max, x, n)


def running_counts(f: Frames, x: str) -> dict[str, Column]:
    """Running sum and count of an integer column, for `counted_total`."""
    return {
        f"__run_{x}": F.coalesce(F.sum(x).over(f.so_far), F.lit(0)),
        f"__held_rows_{x}": F.count(x).over(f.so_far),
    }


def counted_total(f: Frames, x: str, n: int) -> Column:
    """Rolling sum of an integer column as a difference of running sums: exact,
    and of the same cost for any window length."""

    def since(name: str) -> Column:
        return F.col(name) - F.coalesce(f.lag(name, n), F.lit(0))

    return F.when(since(f"__held_rows_{x}") == n, since(f"__run_{x}"))


def values(f: Frames, x: str, n: int) -> Column:
    """The present values among the last n rows, oldest first."""
    return F.collect_list(x).over(f.last(n))


def sorted_values(held: Column, present: Column, n: int) -> Column:
    """The last n entries of a `values` array in order, where they are all
    present, for `sorted_quantile`. Sorting one collected array, once for all
    quantiles of a window, is several times faster here than the exact
    percentile aggregate evaluated per frame."""
    return F.when(present, F.sort_array(F.slice(held, -n, n)))


def quantile_of(held: Column, present: Column, q: float, n: int) -> Column:
    """One quantile of the last n entries of a `values` array."""
    return sorted_quantile(sorted_values(held, present, n), q, n)


def quantile(f: Frames, x: str, q: float, n: int) -> Column:
    return F.when(f.full(x, n), sorted_quantile(F.sort_array(values(f, x, n)), q, n))


def absolute_deviation(f: Frames, x: str, n: int) -> Column:
    """Mean absolute distance from the window mean."""
    mu = F.avg(x).over(f.last(n))
    spread = F.aggregate(
        F.transform(values(f, x, n), lambda v: F.abs(v - mu)), F.lit(0.0), lambda a, v: a + v
    )
    return F.when(f.full(x, n), spread / F.lit(float(n)))


def trend_correlation(f: Frames, x: str, place: str, n: int) -> Column:
    """Correlation of the values with their order; missing on a flat window."""
    w = f.last(n)
    spread = F.stddev_samp(x).over(w)
    flat = F.max(x).over(w) == F.min(x).over(w)
    return F.when(
        f.full(x, n) & ~flat,
        ratio(F.covar_samp(x, place).over(w), spread * F.stddev_samp(place).over(w)),
    )
