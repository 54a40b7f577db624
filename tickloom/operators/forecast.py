"""Multi-step forecasts: simple baselines, a pooled regression, error bands."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.recipe import Level, Recipe, RecipeMaker, add_features
from tickloom.operators.series import Frames, Series, SeriesLayout
from tickloom.operators.statistics import exact_quantiles, row_of
from tickloom.session import materialise

# The quantile levels of the forecast bands.
BAND_LEVELS = (0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98)


def _steps(make, steps: int) -> Column:
    """Array of (step, predicted_price) structs for steps 1..n."""
    return F.array(
        *[
            F.struct(F.lit(k).alias("step"), make(k).cast("double").alias("predicted_price"))
            for k in range(1, steps + 1)
        ]
    )


def baseline(
    method: str, steps: int, *, price: str = "close", span: int = 20, season: int = 24
) -> RecipeMaker:
    """Recipe for the forecasts made at every bar.

    persistence repeats the price, drift continues its move over the last
    `span` rows, seasonal takes the price of the same place one season back.
    """
    p = F.col(price)

    def make(f: Frames) -> Recipe:
        if method == "persistence":
            made, back = _steps(lambda k: p, steps), 0
        elif method == "drift":
            per_row = (p - f.lag(price, span)) / span
            made, back = _steps(lambda k: p + per_row * k, steps), span
        elif method == "seasonal":
            shift = lambda k: (-k) % season
            at = lambda k: p if shift(k) == 0 else f.lag(price, shift(k))
            made, back = _steps(at, steps), season
        else:
            raise ValueError(f"unknown method {method!r}")
        actual = F.array(*[f.lead(price, k) for k in range(1, steps + 1)])
        return Recipe(
            ["__made", "__actual"],
            [Level(add={"__made": made, "__actual": actual})],
            back=back,
            ahead=steps,
        )

    return make


def baseline_forecasts(
    bars: DataFrame,
    series: Series,
    method: str,
    steps: int = 12,
    *,
    price: str = "close",
    span: int = 20,
    season: int = 24,
    layout: SeriesLayout | None = None,
) -> DataFrame:
    """(symbol, asof_ts, step, predicted_price, current_price, actual_price)."""
    make = baseline(method, steps, price=price, span=span, season=season)
    keep = [*series.entity, series.time, price]
    df = add_features(bars, series, [make], layout, keep)
    return (
        df.withColumn("__row", F.explode("__made"))
        .select(
            *series.entity,
            F.col(series.time).alias("asof_ts"),
            F.col("__row.step").alias("step"),
            F.col("__row.predicted_price").alias("predicted_price"),
            F.col(price).alias("current_price"),
            F.get("__actual", F.col("__row.step") - 1).alias("actual_price"),
        )
    )


def with_future_prices(
    df: DataFrame,
    series: Series,
    steps: Sequence[int],
    price: str = "close",
    layout: SeriesLayout | None = None,
) -> DataFrame:
    """`actual_{k}` for every step."""

    def make(f: Frames) -> Recipe:
        out = {f"actual_{k}": f.lead(price, k) for k in steps}
        return Recipe([*out], [Level(add=out)], ahead=max(steps))

    return add_features(df, series, [make], layout)


@dataclass
class PooledLine:
    intercept: float
    coefficients: list[float]


def fit_pooled_regression(
    train: DataFrame, features: Sequence[str], steps: Sequence[int]
) -> dict[int, PooledLine]:
    """One least-squares model per step over all entities together. The columns
    are written once; one pass gives the means, and one the centred sums of products
    of all steps, whose number depends on the features and steps alone. Rows with
    a missing feature or price are left out."""
    names = [*features, *[f"actual_{k}" for k in steps]]
    held = materialise(train.select(*[F.col(c).cast("double").alias(c) for c in names]), "regression")
    held = held.dropna(subset=list(features))
    centre = [m or 0.0 for m in row_of(held, [f"avg(`{c}`)" for c in names])]
    width = len(features)
    gram = _products(held, names, width, centre)
    models = {}
    for at, k in enumerate(steps):
        n, first, square = gram[at, 0, 0], gram[at, 0, 1 : width + 1], gram[at, 1 : width + 1, 1 : width + 1]
        y, cross = gram[at, 0, width + 1], gram[at, 1 : width + 1, width + 1]
        mean, mean_y = first / max(n, 1.0), y / max(n, 1.0)
        slope = np.linalg.lstsq(square - n * np.outer(mean, mean), cross - n * mean * mean_y, rcond=None)[0]
        origin = centre[width + at] + mean_y - slope @ (np.array(centre[:width]) + mean)
        models[k] = PooledLine(float(origin), slope.tolist())
    return models


def _products(held: DataFrame, names: Sequence[str], width: int, centre: Sequence[float]) -> np.ndarray:
    """Per step the sums of products of (1, features) with (1, features, the step's price),
    over the rows that have this price; all less `centre`.

    A row gives one cell per feature, whose products with the whole row are one sum
    per other column; cells are combined by feature and by the set of prices present
    before the shuffle, so the expressions grow with the columns and not with their pairs.
    """
    moved = [F.col(c) - F.lit(m) for c, m in zip(names, centre)]
    x, y = [F.lit(1.0), *moved[:width]], moved[width:]
    present = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(s)) for s, c in enumerate(names[width:])]))
    rows = held.select(F.array(*x).alias("__x"), F.array(*[F.coalesce(v, F.lit(0.0)) for v in y]).alias("__y"), present.alias("__steps"))
    cells = rows.select("*", F.posexplode("__x").alias("__i", "__v"))
    others = [F.get("__x", F.lit(j)) for j in range(width + 1)] + [F.get("__y", F.lit(s)) for s in range(len(y))]
    summed = cells.groupBy("__steps", "__i").agg(F.array(*[F.sum(F.col("__v") * c) for c in others]).alias("__sums"))
    by_step = summed.select(F.explode("__steps").alias("__step"), "__i", "__sums").select("__step", "__i", F.posexplode("__sums").alias("__j", "__sum"))
    found = np.zeros((len(y), width + 1, width + 2))
    for r in by_step.groupBy("__step", "__i", "__j").agg(F.sum("__sum").alias("total")).collect():
        if r["__j"] <= width:
            found[r["__step"], r["__i"], r["__j"]] = r.total
        elif r["__j"] == width + 1 + r["__step"]:
            found[r["__step"], r["__i"], width + 1] = r.total
    return found


def regression_forecasts(
    df: DataFrame,
    models: dict[int, PooledLine],
    features: Sequence[str],
    keys: Sequence[str],
    price: str = "close",
) -> DataFrame:
    """Long forecasts of every model, computed as plain column arithmetic."""
    made = []
    for k, model in models.items():
        predicted = F.lit(float(model.intercept))
        for name, weight in zip(features, model.coefficients):
            predicted = predicted + F.col(name) * F.lit(float(weight))
        actual = F.col(f"actual_{k}") if f"actual_{k}" in df.columns else F.lit(None).cast("double")
        made.append(
            F.struct(
                F.lit(k).alias("step"),
                predicted.alias("predicted_price"),
                actual.alias("actual_price"),
            )
        )
    return df.select(
        *keys, F.col(price).alias("current_price"), F.explode(F.array(*made)).alias("__row")
    ).select(*keys, "current_price", "__row.*")


def residual_bands(
    forecasts: DataFrame, steps: int, levels: Sequence[float] = BAND_LEVELS
) -> DataFrame:
    """(step, level, residual): quantiles of actual minus predicted per step."""
    residual = F.col("actual_price") - F.col("predicted_price")
    names = [f"r{k}" for k in range(1, steps + 1)]
    wide = forecasts.select(
        *[F.when(F.col("step") == k, residual).alias(n) for k, n in enumerate(names, 1)]
    )
    found = exact_quantiles(wide, names, levels)
    rows = [(k, q, found[n, q]) for k, n in enumerate(names, 1) for q in levels]
    return forecasts.sparkSession.createDataFrame(rows, "step int, level double, residual double")


def with_bands(forecasts: DataFrame, bands: DataFrame) -> DataFrame:
    """Forecasts with one price per level, `q02` to `q98`. The band table has
    one row per step and level."""
    levels = sorted({r.level for r in bands.select("level").distinct().collect()})
    wide = bands.groupBy("step").agg(
        *[
            F.max(F.when(F.col("level") == q, F.col("residual"))).alias(f"q{round(q * 100):02d}")
            for q in levels
        ]
    )
    names = [c for c in wide.columns if c != "step"]
    return forecasts.join(F.broadcast(wide), "step", "left").withColumns(
        {n: F.col("predicted_price") + F.col(n) for n in names}
    )

