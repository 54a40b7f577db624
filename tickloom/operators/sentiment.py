"""Features of the per-bar news columns, as recipe makers for `add_features`.

`sent_mean` and `sent_max_abs` are missing on bars without news, and windows
over them are missing until full; `fill_missing` changes that where wanted.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import rolling as R
from tickloom.functions.numeric import flag, sorted_quantile
from tickloom.functions.smoothing import weighted_means
from tickloom.operators.recipe import Level, Recipe, RecipeMaker, add_features
from tickloom.operators.series import Frames, Series, SeriesLayout, plan_series

COLUMNS = ("sent_mean", "sent_max_abs", "bullish_cnt", "bearish_cnt", "headline_count")
MOVING = ("sent_mean", "bullish_cnt", "bearish_cnt", "headline_count")
SCORES = ("sent_mean", "sent_max_abs")


def rolling_statistics(
    f: Frames, columns: Sequence[str] = COLUMNS, sizes: Sequence[int] = (3, 7, 14, 30)
):
    longest = max(sizes)
    held, ordered, stats, outputs = {}, {}, {}, []
    for c in columns:
        held[f"__held_{c}"] = R.values(f, c, longest)
        for n in sizes:
            held |= {
                f"__full_{c}_{n}": f.full(c, n),
                f"{c}_ma_{n}": R.mean(f, c, n),
                f"{c}_std_{n}": R.deviation(f, c, n),
                f"{c}_min_{n}": R.lowest(f, c, n),
                f"{c}_max_{n}": R.highest(f, c, n),
            }
            ordered[f"__ordered_{c}_{n}"] = R.sorted_values(F.col(f"__held_{c}"), F.col(f"__full_{c}_{n}"), n)
            stats |= {
                f"{c}_q25_{n}": sorted_quantile(F.col(f"__ordered_{c}_{n}"), 0.25, n),
                f"{c}_q75_{n}": sorted_quantile(F.col(f"__ordered_{c}_{n}"), 0.75, n),
                f"{c}_zscore_{n}": (F.col(c) - F.col(f"{c}_ma_{n}"))
                / (F.col(f"{c}_std_{n}") + 1e-10),
            }
            outputs += [f"{c}_{s}_{n}" for s in ("ma", "std", "min", "max", "q25", "q75", "zscore")]
    return Recipe(outputs, [Level(add=held), Level(add=ordered), Level(add=stats)], back=longest)


def moves(
    f: Frames, columns: Sequence[str] = MOVING, periods: Sequence[int] = (1, 3, 5, 10)
):
    out = {f"{c}_momentum_{p}": F.col(c) - f.lag(c, p) for c in columns for p in periods}
    return Recipe([*out], [Level(add=out)], back=max(periods))


def accelerations(
    f: Frames, columns: Sequence[str] = MOVING, periods: Sequence[int] = (3, 5, 10)
):
    out = {
        f"{c}_acceleration_{p}": F.col(c) - 2 * f.lag(c, p) + f.lag(c, 2 * p)
        for c in columns
        for p in periods
    }
    return Recipe([*out], [Level(add=out)], back=2 * max(periods))


def smoothed_momentum(f: Frames, columns: Sequence[str] = MOVING, short: int = 3, long: int = 10):
    means = {f"__short_{c}": (c, short) for c in columns}
    means |= {f"__long_{c}": (c, long) for c in columns}
    levels, back = weighted_means(f, means)
    out = {f"{c}_ema_momentum": F.col(f"__short_{c}") - F.col(f"__long_{c}") for c in columns}
    return Recipe([*out], [*levels, Level(add=out)], back=back)


def trend_strength(f: Frames, columns: Sequence[str] = MOVING, n: int = 10):
    out = {f"{c}_trend_strength": R.trend_correlation(f, c, "__pos", n) for c in columns}
    return Recipe([*out], [Level(add=out)], back=n, number=True)


def news_intensity(f: Frames, sizes: Sequence[int] = (6, 12, 24, 48)):
    """Sums over bars; the names say hours as the inputs of old did."""
    running = R.running_counts(f, "headline_count")
    out = {f"news_intensity_{n}h": R.counted_total(f, "headline_count", n) for n in sizes}
    return Recipe([*out], [Level(add=running), Level(add=out)], back=max(sizes))


def news_frequency(f: Frames, hour: int = 12, day: int = 288):
    running = R.running_counts(f, "headline_count")
    out = {
        "news_frequency_hourly": R.counted_total(f, "headline_count", hour) / F.lit(float(hour)),
        "news_frequency_daily": R.counted_total(f, "headline_count", day) / F.lit(float(day)),
    }
    return Recipe([*out], [Level(add=running), Level(add=out)], back=day)


def news_burst(f: Frames, n: int = 24):
    usual = R.mean(f, "headline_count", n) + 2 * R.deviation(f, "headline_count", n)
    out = {"news_burst": flag(F.col("headline_count") > usual)}
    return Recipe([*out], [Level(add=out)], back=n)


def news_drought(f: Frames, n: int = 12):
    return Recipe(
        ["news_drought"],
        [
            Level(add={"__quiet": flag(F.col("headline_count") == 0)}),
            Level(add={"news_drought": R.total(f, "__quiet", n)}),
        ],
        back=n,
    )


def time_since_news(f: Frames):
    """Bars since the last one with news; before the first, since the start."""
    at_news = F.when(F.col("headline_count") > 0, F.col("__pos"))
    since = F.col("__pos") - F.coalesce(F.col("__news_pos"), F.lit(0))
    return Recipe(
        ["time_since_news"],
        [Level(carry={"__news_pos": at_news}), Level(add={"time_since_news": since})],
        number=True,
    )


def sentiment_regimes(f: Frames, n: int = 100):
    x = F.col("sent_mean")
    held = {"__held_regime": R.values(f, "sent_mean", n), "__full_regime": f.full("sent_mean", n)}
    quartile = partial(R.quantile_of, F.col("__held_regime"), F.col("__full_regime"))
    low, high = quartile(0.25, n), quartile(0.75, n)
    out = {
        "sentiment_regime_bullish": flag(x > high),
        "sentiment_regime_bearish": flag(x < low),
        "sentiment_regime_neutral": flag((x >= low) & (x <= high)),
    }
    return Recipe([*out], [Level(add=held), Level(add=out)], back=n)


def sentiment_volatility(f: Frames, short: int = 24, long: int = 100):
    return Recipe(
        ["high_sentiment_volatility"],
        [
            Level(add={"__sent_std": R.deviation(f, "sent_mean", short)}),
            Level(
                add={
                    "high_sentiment_volatility": flag(
                        F.col("__sent_std") > R.quantile(f, "__sent_std", 0.75, long)
                    )
                }
            ),
        ],
        back=short + long,
    )


def extreme_sentiment(f: Frames):
    out = {
        "extreme_positive_sentiment": flag(F.col("sent_mean") > 0.5),
        "extreme_negative_sentiment": flag(F.col("sent_mean") < -0.5),
    }
    return Recipe([*out], [Level(add=out)])


def sentiment_persistence(f: Frames, sizes: Sequence[int] = (6, 12, 24)):
    signs = {
        "__above": flag(F.col("sent_mean") > 0),
        "__below": flag(F.col("sent_mean") < 0),
    }
    out = {}
    for n in sizes:
        out |= {
            f"bullish_persistence_{n}h": R.total(f, "__above", n) / F.lit(float(n)),
            f"bearish_persistence_{n}h": R.total(f, "__below", n) / F.lit(float(n)),
        }
    return Recipe([*out], [Level(add=signs), Level(add=out)], back=max(sizes))


SENTIMENT_GROUPS: dict[str, RecipeMaker] = {
    "rolling_statistics": rolling_statistics,
    "moves": moves,
    "accelerations": accelerations,
    "smoothed_momentum": smoothed_momentum,
    "trend_strength": trend_strength,
    "news_intensity": news_intensity,
    "news_frequency": news_frequency,
    "news_burst": news_burst,
    "news_drought": news_drought,
    "time_since_news": time_since_news,
    "sentiment_regimes": sentiment_regimes,
    "sentiment_volatility": sentiment_volatility,
    "extreme_sentiment": extreme_sentiment,
    "sentiment_persistence": sentiment_persistence,
}


def sentiment_features(
    bars: DataFrame,
    series: Series,
    *,
    groups: Sequence[str] | None = None,
    fill_missing: str | None = None,
    layout: SeriesLayout | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Bars with news columns plus all sentiment features, or those of `groups`.

    fill_missing: None keeps missing sentiment, "zero" makes it 0 and "ffill"
    repeats the last one.
    """
    layout = layout or plan_series(bars, series)
    if fill_missing == "zero":
        bars = bars.fillna(0.0, subset=list(SCORES))
    elif fill_missing == "ffill":
        bars = layout.open(bars).carry({c: F.col(c) for c in SCORES}).close()
    elif fill_missing is not None:
        raise ValueError(f"unknown fill_missing {fill_missing!r}")
    makers = [SENTIMENT_GROUPS[g] for g in (groups if groups is not None else SENTIMENT_GROUPS)]
    return add_features(bars, series, makers, layout, keep)
