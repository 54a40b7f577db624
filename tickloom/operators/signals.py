"""Price forecasts to directions, signals and their summaries.

A prediction table has one row per (entity, as-of time, step) with
predicted_price and current_price. Nothing is invented for missing prices:
their direction is NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import clamp, ratio

# Percent thresholds of confident moves and of magnitudes, the
# width of the probability scale, and the confidence cut-offs.
CONFIDENT = 0.5
STRONG, MODERATE, WEAK = 2.0, 1.0, 0.5
SCALE = 5.0
ENSEMBLE_CONFIDENCE = 0.7
HIGH_CONFIDENCE = 0.8

UP, DOWN, NEUTRAL = "UP", "DOWN", "NEUTRAL"


def classify(predictions: DataFrame) -> DataFrame:
    """Change, direction, magnitude, joined label and up/down probability."""
    change = F.col("predicted_price") - F.col("current_price")
    pct = F.col("price_change_pct")
    size = F.abs(pct)
    known = pct.isNotNull()
    return (
        predictions.withColumn("price_change", change)
        .withColumn("price_change_pct", ratio(F.col("price_change"), F.col("current_price")) * 100)
        .withColumns(
            {
                "direction": F.when(
                    F.col("price_change").isNotNull(),
                    F.when(F.col("price_change") > 0, UP).otherwise(DOWN),
                ),
                "direction_confident": F.when(pct > CONFIDENT, UP)
                .when(pct < -CONFIDENT, DOWN)
                .when(known, NEUTRAL),
                "magnitude": F.when(size > STRONG, "STRONG")
                .when(size > MODERATE, "MODERATE")
                .when(size > WEAK, "WEAK")
                .when(known, "MINIMAL"),
                "up_probability": clamp((pct + SCALE) / (2 * SCALE), 0.0, 1.0),
            }
        )
        .withColumns(
            {
                "classification": F.when(
                    known, F.concat_ws("_", "direction_confident", "magnitude")
                ),
                "down_probability": 1 - F.col("up_probability"),
            }
        )
    )


def confidence() -> Column:
    p = F.col("up_probability")
    return F.when(p.isNotNull(), F.greatest(p, 1 - p))


def _keys(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [k for k in keys if k in df.columns]


KEYS = ("symbol", "asof_ts", "step")


def direction_only(classified: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    names = [
        *_keys(classified, keys),
        "direction",
        "direction_confident",
        "classification",
        "up_probability",
        "down_probability",
        "price_change_pct",
    ]
    return classified.select(*names, confidence().alias("confidence"))


def trend_direction(predictions: DataFrame, by: Sequence[str] = ("symbol", "asof_ts")) -> DataFrame:
    """Direction of the line through an entity's predicted steps, and as
    confidence how close the predictions are to that line."""
    x, y = F.col("step").cast("double"), F.col("predicted_price")
    both = y.isNotNull()
    x = F.when(both, x)
    slope = ratio(F.covar_pop(y, x), F.var_pop(x))
    fit = ratio(F.covar_samp(y, x), F.stddev_samp(y) * F.stddev_samp(x))
    return (
        predictions.groupBy(*by)
        .agg(slope.alias("slope"), F.abs(fit).alias("trend_confidence"))
        .withColumn(
            "trend_direction",
            F.when(F.col("slope").isNotNull(), F.when(F.col("slope") > 0, UP).otherwise(DOWN)),
        )
    )


def ensemble(
    directions: DataFrame,
    trends: DataFrame | None = None,
    by: Sequence[str] = ("symbol", "asof_ts"),
    least: float = ENSEMBLE_CONFIDENCE,
) -> DataFrame:
    """Keeps a direction of enough confidence, else NEUTRAL. With `trends` the
    trend has to agree as well."""
    agreed = F.col("confidence") > least
    if trends is not None:
        directions = directions.join(trends.select(*by, "trend_direction"), list(by), "left")
        agreed = agreed & (F.col("trend_direction") == F.col("direction"))
    picked = F.when(agreed, F.col("direction")).otherwise(NEUTRAL)
    return directions.withColumn(
        "direction", F.when(F.col("direction").isNotNull(), picked)
    ).drop("trend_direction")


def trading_signals(classified: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return classified.select(
        *_keys(classified, keys),
        F.col("direction").alias("signal"),
        confidence().alias("confidence"),
        F.col("magnitude").alias("strength"),
        F.col("predicted_price").alias("price_target"),
        F.col("price_change_pct").alias("change_percent"),
    )


def latest_directions(classified: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return classified.select(
        *_keys(classified, keys),
        "predicted_price",
        "direction",
        "direction_confident",
        "price_change_pct",
        "up_probability",
        "classification",
    )


def current_prices(
    bars: DataFrame, entity: str = "symbol", time: str = "bar_ts", price: str = "close"
) -> DataFrame:
    """Last known price per entity; an entity without any is an error for the
    caller to see, not a default."""
    known = F.when(F.col(price).isNotNull(), F.col(time))
    return bars.groupBy(entity).agg(
        F.max_by(price, known).alias("current_price"), F.max(known).alias("asof_ts")
    )


def require_prices(predictions: DataFrame) -> DataFrame:
    if not predictions.where(F.col("current_price").isNull()).isEmpty():
        raise ValueError("predictions without a current price")
    return predictions


def signal_view(
    signals: DataFrame, by: Sequence[str] = ("symbol", "asof_ts"), *, steps: int
) -> DataFrame:
    """First steps per forecast, with a grade of 0 to 5 and a high-confidence mark."""
    order = Window.partitionBy(*by).orderBy("step")
    return (
        signals.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= steps)
        .withColumns(
            {
                "grade": F.floor(F.col("confidence") * 5).cast("int"),
                "high_confidence": F.coalesce(
                    (F.col("confidence") > HIGH_CONFIDENCE).cast("int"), F.lit(0)
                ),
            }
        )
    )


def high_confidence(signals: DataFrame, least: float = HIGH_CONFIDENCE) -> DataFrame:
    return signals.where(F.col("confidence") > least)
