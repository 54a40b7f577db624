"""Bar features: bands, volume, momentum, candles, volatility, levels, clock.

Input columns are open, high, low, close and volume. Each group is a recipe
maker for `add_features`; `technical_features` applies them all.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import rolling as R
from tickloom.functions.numeric import flag, ratio, strict_greatest, strict_least
from tickloom.functions.smoothing import weighted_means
from tickloom.operators.recipe import Level, Recipe, RecipeMaker, add_features
from tickloom.operators.series import Frames, Series, SeriesLayout

TINY = 1e-10  # fixed value: guards the ratios of candle and flow features


def _inputs():
    return tuple(F.col(c) for c in ("open", "high", "low", "close", "volume"))


def _typical():
    _, high, low, close, _ = _inputs()
    return (high + low + close) / 3


def _flow():
    """Money flow: volume weighted by the place of the close in its range."""
    _, high, low, close, volume = _inputs()
    return ((close - low) - (high - close)) / (high - low + TINY) * volume


def _filled_change(f: Frames, name: str, k: int):
    return ratio(F.col(name), f.lag(name, k)) - 1


def bands(f: Frames, periods: Sequence[int] = (20, 50), centre: dict[int, str] | None = None):
    """Bollinger position, width and distances, squeeze and breakouts.

    centre maps a period to a column holding its moving average; without it
    the average is computed.
    """
    _, _, _, close, _ = _inputs()
    centre = centre or {}
    first, second, third, outputs = {}, {}, {}, []
    for p in periods:
        mid = F.col(centre[p]) if p in centre else R.mean(f, "close", p)
        first |= {f"__mid_{p}": mid, f"__dev_{p}": R.deviation(f, "close", p)}
        m, d = F.col(f"__mid_{p}"), F.col(f"__dev_{p}")
        top, bottom = m + 2 * d, m - 2 * d
        second |= {
            f"bb_{p}_position": ratio(close - bottom, top - bottom),
            f"bb_{p}_width": ratio(top - bottom, m),
            f"bb_{p}_upper_dist": ratio(top - close, close),
            f"bb_{p}_lower_dist": ratio(close - bottom, close),
            f"bb_{p}_breakout_up": flag(close > top),
            f"bb_{p}_breakout_down": flag(close < bottom),
        }
        width = f"bb_{p}_width"
        third[f"bb_{p}_squeeze"] = flag(F.col(width) < R.quantile(f, width, 0.2, 20))
        parts = ("position", "width", "upper_dist", "lower_dist", "squeeze")
        outputs += [f"bb_{p}_{x}" for x in (*parts, "breakout_up", "breakout_down")]
    return Recipe(
        outputs,
        [Level(add=first), Level(add=second), Level(add=third)],
        back=max(periods) + 19,
    )


def on_balance_volume(f: Frames):
    _, _, _, close, volume = _inputs()
    signed = F.signum(close - f.lag("close")) * volume
    return Recipe(
        ["obv", "obv_ma_10", "obv_momentum"],
        [
            Level(cumulate={"obv": signed}),
            Level(
                add={
                    "obv_ma_10": R.mean(f, "obv", 10),
                    "obv_momentum": F.col("obv") - f.lag("obv", 5),
                }
            ),
        ],
        back=11,
    )


def volume_price_trend(f: Frames):
    _, _, _, close, volume = _inputs()
    return Recipe(
        ["vpt", "vpt_ma_10"],
        [
            Level(cumulate={"vpt": volume * _filled_change(f, "__close", 1)}),
            Level(add={"vpt_ma_10": R.mean(f, "vpt", 10)}),
        ],
        back=11,
        filled={"__close": close},
    )


def accumulation(f: Frames):
    return Recipe(
        ["ad_line", "ad_line_ma_10"],
        [Level(cumulate={"ad_line": _flow()}), Level(add={"ad_line_ma_10": R.mean(f, "ad_line", 10)})],
        back=10,
    )


def money_flow_ratio(f: Frames):
    return Recipe(
        ["cmf_20"],
        [
            Level(add={"__mfv": _flow()}),
            Level(add={"cmf_20": ratio(R.total(f, "__mfv", 20), R.total(f, "volume", 20))}),
        ],
        back=20,
    )


def volume_weighted_means(f: Frames, periods: Sequence[int] = (10, 20)):
    _, _, _, close, volume = _inputs()
    means = {
        f"vwma_{p}": ratio(R.total(f, "__turnover", p), R.total(f, "volume", p)) for p in periods
    }
    gaps = {f"price_to_vwma_{p}": (ratio(close, F.col(f"vwma_{p}")) - 1) * 100 for p in periods}
    return Recipe(
        [*means, *gaps],
        [Level(add={"__turnover": close * volume}), Level(add=means), Level(add=gaps)],
        back=max(periods),
    )


def volume_ratios(f: Frames, means: Sequence[int] = (5, 10, 20), changes: Sequence[int] = (5, 10)):
    _, _, _, _, volume = _inputs()
    columns = {f"volume_ratio_{p}": ratio(volume, R.mean(f, "volume", p)) for p in means}
    columns |= {f"volume_roc_{p}": _filled_change(f, "__volume", p) * 100 for p in changes}
    return Recipe(
        [*columns], [Level(add=columns)], back=max(*means, *changes) + 1, filled={"__volume": volume}
    )


def money_flow_index(f: Frames, n: int = 14):
    _, _, _, _, volume = _inputs()
    typical, before = F.col("__tp"), f.lag("__tp")
    moved = typical * volume
    return Recipe(
        ["mfi"],
        [
            Level(add={"__tp": _typical()}),
            Level(
                add={
                    "__gain": F.when(typical > before, moved).otherwise(0.0),
                    "__loss": F.when(typical < before, moved).otherwise(0.0),
                }
            ),
            Level(
                add={
                    "mfi": 100
                    - ratio(
                        F.lit(100.0),
                        1 + ratio(R.total(f, "__gain", n), R.total(f, "__loss", n) + TINY),
                    )
                }
            ),
        ],
        back=n + 1,
    )


def rsi_states(f: Frames, rsi_col: str = "rsi"):
    _, _, _, close, _ = _inputs()
    rsi = F.col(rsi_col)
    against = (rsi - f.lag(rsi_col, 5)) * _filled_change(f, "__close", 5)
    columns = {
        "rsi_overbought": flag(rsi > 70),
        "rsi_oversold": flag(rsi < 30),
        "rsi_divergence": flag(against < 0),
        "rsi_momentum": rsi - f.lag(rsi_col, 3),
    }
    return Recipe([*columns], [Level(add=columns)], back=6, filled={"__close": close})


def macd_crosses(f: Frames, macd_col: str = "macd", signal_col: str = "macd_signal"):
    macd, signal = F.col(macd_col), F.col(signal_col)
    columns = {
        "macd_bullish_cross": flag((macd > signal) & (f.lag(macd) <= f.lag(signal))),
        "macd_bearish_cross": flag((macd < signal) & (f.lag(macd) >= f.lag(signal))),
        "macd_momentum": (macd - signal) - f.lag(macd - signal, 3),
    }
    return Recipe([*columns], [Level(add=columns)], back=3)


def momentum(f: Frames, periods: Sequence[int] = (1, 5, 10, 20)):
    _, _, _, close, _ = _inputs()
    first = {f"momentum_{p}": _filled_change(f, "__close", p) * 100 for p in periods}
    second = {
        f"acceleration_{p}": F.col(f"momentum_{p}") - f.lag(f"momentum_{p}", 5) for p in (5, 10)
    }
    return Recipe(
        [*first, *second],
        [Level(add=first), Level(add=second)],
        back=max(periods) + 6,
        filled={"__close": close},
    )


def channel_index(f: Frames, n: int = 20):
    gap = F.col("__tp") - R.mean(f, "__tp", n)
    return Recipe(
        ["cci"],
        [
            Level(add={"__tp": _typical()}),
            Level(add={"__tp_gap": gap, "__tp_mad": R.absolute_deviation(f, "__tp", n)}),
            Level(add={"cci": ratio(F.col("__tp_gap"), 0.015 * F.col("__tp_mad"))}),
        ],
        back=n,
    )


def rates_of_change(f: Frames, periods: Sequence[int] = (1, 3, 5, 10, 15, 20)):
    """Unfilled rates; those over 5 and 10 rows also smoothed."""
    _, _, _, close, _ = _inputs()
    rates = {f"roc_{p}": (ratio(close, f.lag("close", p)) - 1) * 100 for p in periods}
    smooth = {"roc_ema_5": ("roc_5", 3), "roc_ema_10": ("roc_10", 5)}
    levels, back = weighted_means(f, smooth)
    return Recipe([*rates, *smooth], [Level(add=rates), *levels], back=back + max(periods))


def candles(f: Frames):
    open_, high, low, close, _ = _inputs()
    body, height = F.abs(close - open_), high - low
    above = high - strict_greatest(close, open_)
    below = strict_least(close, open_) - low
    columns = {
        "body_ratio": ratio(body, height + TINY),
        "upper_shadow_ratio": ratio(above, height + TINY),
        "lower_shadow_ratio": ratio(below, height + TINY),
    }
    return Recipe([*columns], [Level(add=columns)])


def bar_relations(f: Frames):
    """Gaps against the last close, inside and outside bars."""
    open_, high, low, _, _ = _inputs()
    columns = {
        "gap_up": flag(open_ > f.lag("close")),
        "gap_down": flag(open_ < f.lag("close")),
        "inside_bar": flag((high < f.lag("high")) & (low > f.lag("low"))),
        "outside_bar": flag((high > f.lag("high")) & (low < f.lag("low"))),
    }
    return Recipe([*columns], [Level(add=columns)], back=1)


def candle_shapes(f: Frames):
    open_, high, low, close, _ = _inputs()
    body, height = F.abs(close - open_), high - low
    above = high - strict_greatest(close, open_)
    below = strict_least(close, open_) - low
    columns = {
        "doji": flag(ratio(body, height + TINY) < 0.1),
        "hammer": flag((below > 2 * body) & (above < body)),
    }
    return Recipe([*columns], [Level(add=columns)])


def volatility(
    f: Frames, periods: Sequence[int] = (5, 10, 20, 50), periods_per_year: float = 252.0
):
    _, _, _, close, _ = _inputs()
    scale = math.sqrt(periods_per_year)
    levels = {
        f"volatility_{p}": R.deviation(f, "__return", p) * F.lit(scale) * 100 for p in periods
    }
    last = {"normalized_volatility": ratio(F.col("volatility_20"), R.mean(f, "volatility_20", 50))}
    return Recipe(
        [*levels, *last],
        [
            Level(add={"__return": _filled_change(f, "__close", 1)}),
            Level(add=levels),
            Level(add=last),
        ],
        back=max(*periods, 20 + 49) + 1,
        filled={"__close": close},
    )


def true_ranges(f: Frames, periods: Sequence[int] = (14, 21)):
    _, high, low, _, _ = _inputs()
    before = f.lag("close")
    span = strict_greatest(high - low, F.abs(high - before), F.abs(low - before))
    means = {f"atr_{p}": R.mean(f, "true_range", p) for p in periods}
    return Recipe(
        ["true_range", *means],
        [Level(add={"true_range": span}), Level(add=means)],
        back=max(periods) + 1,
    )


def pivots(f: Frames, n: int = 20):
    _, _, _, close, _ = _inputs()
    top, bottom = F.col("__top"), F.col("__bottom")
    pivot = (top + bottom + close) / 3
    resistance, support = 2 * pivot - bottom, 2 * pivot - top
    columns = {
        "pivot_point": pivot,
        "resistance_1": resistance,
        "support_1": support,
        "distance_to_resistance": ratio(resistance - close, close) * 100,
        "distance_to_support": ratio(close - support, close) * 100,
    }
    edges = {"__top": R.highest(f, "high", n), "__bottom": R.lowest(f, "low", n)}
    return Recipe([*columns], [Level(add=edges), Level(add=columns)], back=n)


def local_extrema(f: Frames, reaches: Sequence[int] = (5, 10)):
    """Centred highs and lows. These look ahead by k rows: not for models that
    must not see the future, and not for streams."""
    _, high, low, _, _ = _inputs()
    columns = {}
    for k in reaches:
        w, n = f.around(k), 2 * k + 1
        top = F.when(F.count("high").over(w) == n, F.max("high").over(w))
        bottom = F.when(F.count("low").over(w) == n, F.min("low").over(w))
        columns |= {f"local_max_{k}": flag(top == high), f"local_min_{k}": flag(bottom == low)}
    return Recipe([*columns], [Level(add=columns)], back=max(reaches), ahead=max(reaches))


def clock(f: Frames):
    time = F.col(f.series.time)
    parts = {
        "hour": (F.hour(time), 24),
        "dow": (F.weekday(time), 7),
        "dom": (F.dayofmonth(time), 31),
        "month": (F.month(time), 12),
    }
    columns = {}
    for name, (value, cycle) in parts.items():
        angle = F.lit(2 * math.pi) * value / cycle
        columns |= {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}
    return Recipe([*columns], [Level(add=columns)])


def sessions(f: Frames, opens: int = 9, closes: int = 16, early: int = 4):
    hour = F.hour(F.col(f.series.time))
    columns = {
        "market_open": flag((hour >= opens) & (hour < closes)),
        "pre_market": flag((hour >= early) & (hour < opens)),
        "after_hours": flag((hour >= closes) | (hour < early)),
    }
    return Recipe([*columns], [Level(add=columns)])


#: All groups that need nothing but a bar table, in reporting order.
BAR_GROUPS: dict[str, RecipeMaker] = {
    "bands": bands,
    "candles": candles,
    "bar_relations": bar_relations,
    "candle_shapes": candle_shapes,
    "on_balance_volume": on_balance_volume,
    "volume_price_trend": volume_price_trend,
    "accumulation": accumulation,
    "money_flow_ratio": money_flow_ratio,
    "volume_weighted_means": volume_weighted_means,
    "volume_ratios": volume_ratios,
    "money_flow_index": money_flow_index,
    "pivots": pivots,
    "local_extrema": local_extrema,
    "momentum": momentum,
    "channel_index": channel_index,
    "rates_of_change": rates_of_change,
    "volatility": volatility,
    "true_ranges": true_ranges,
    "clock": clock,
    "sessions": sessions,
}

LOOKS_AHEAD = ("local_extrema",)


def technical_features(
    bars: DataFrame,
    series: Series,
    *,
    groups: Sequence[str] | None = None,
    sma_cols: dict[int, str] | None = None,
    rsi_col: str | None = None,
    macd_cols: tuple[str, str] | None = None,
    periods_per_year: float = 252.0,
    layout: SeriesLayout | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Bars with every technical feature, or with those of `groups`."""
    if bars.isStreaming:
        raise ValueError("technical features need row windows, which a stream does not have")
    chosen = dict(BAR_GROUPS)
    chosen["bands"] = partial(bands, centre=sma_cols)
    chosen["volatility"] = partial(volatility, periods_per_year=periods_per_year)
    makers = [chosen[g] for g in (groups if groups is not None else chosen)]
    if rsi_col:
        makers.append(partial(rsi_states, rsi_col=rsi_col))
    if macd_cols:
        makers.append(partial(macd_crosses, macd_col=macd_cols[0], signal_col=macd_cols[1]))
    return add_features(bars, series, makers, layout, keep)
