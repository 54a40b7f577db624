"""Bars from ticks, and the bound a fixed time grid puts on their number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.sources.tables import one_per_key


def bar_columns(at: str, value: str, size: str | None = None) -> list[Column]:
    """Aggregates of one bar; `size` is a traded-size column, else ticks count.

    A single ordering column of fixed width keeps this a hash aggregate.
    """
    volume = F.sum(size) if size else F.count(F.lit(1))
    return [
        F.min_by(value, at).alias("open"),
        F.max(value).alias("high"),
        F.min(value).alias("low"),
        F.max_by(value, at).alias("close"),
        volume.cast("double").alias("volume"),
    ]


def bars_from_ticks(
    ticks: DataFrame,
    *,
    entity: str | Column,
    time: str = "ts",
    value: str = "value",
    at: str | None = None,
    step: str = "5 minutes",
    size: str | None = None,
) -> DataFrame:
    """(symbol, bar_ts, open, high, low, close, volume). One partial-aggregated
    shuffle, so a symbol with very many ticks does not overload a task.

    `at` orders the ticks inside a bar where `time` alone does not.
    """
    symbol = F.col(entity) if isinstance(entity, str) else entity
    columns = dict.fromkeys(c for c in (at or time, value, size) if c)
    return (
        ticks.select(
            symbol.alias("symbol"), F.window(time, step).start.alias("bar_ts"), *columns
        )
        .groupBy("symbol", "bar_ts")
        .agg(*bar_columns(at or time, value, size))
    )


def grid_bound(ticks: DataFrame, step_seconds: int, time: str = "ts") -> int:
    """Upper bound of bars per symbol: grid slots between first and last tick.

    Reads one column; the result proves a `Series.max_rows`.
    """
    seconds = F.unix_seconds(F.col(time).cast("timestamp"))
    first, last = ticks.agg(F.min(seconds), F.max(seconds)).first()
    return 0 if first is None else (last - first) // step_seconds + 2


def distinct_bars(bars: DataFrame, prefer: Column | None = None) -> DataFrame:
    """One bar per (symbol, bar_ts); on repeats the greatest `prefer` wins, and
    among equals the greatest by all columns in order."""
    return one_per_key(bars, ["symbol", "bar_ts"], prefer)


def pivot_indicators(long: DataFrame, names: list[str]) -> DataFrame:
    """(symbol, indicator, bar_ts, value) rows to one column per declared name;
    of repeated values the greatest."""
    picked = [
        F.max(F.when(F.col("indicator") == n, F.col("value"))).alias(n.lower()) for n in names
    ]
    return long.groupBy("symbol", "bar_ts").agg(*picked)


def full_bars(
    bars: DataFrame, indicators: DataFrame, names: list[str], prefer: Column | None = None
) -> DataFrame:
    """All landed bars without repeats, with their indicators where present."""
    wide = pivot_indicators(indicators, names)
    return distinct_bars(bars, prefer).join(wide, ["symbol", "bar_ts"], "left")
