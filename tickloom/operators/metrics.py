"""Error metrics, direction statistics and back-tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import ratio
from tickloom.operators.signals import DOWN, HIGH_CONFIDENCE, NEUTRAL, UP, confidence

SMALL = 1e-8  # fixed value: truths up to this size stay out of the percentage error


def regression_metrics(
    df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()
) -> DataFrame:
    """mae, mse, rmse, mape (percent; 0 without a usable truth), n."""
    y, p = F.col(truth), F.col(predicted)
    error = y - p
    usable = F.when(F.abs(y) > SMALL, F.abs(ratio(error, y)))
    return df.where(y.isNotNull() & p.isNotNull()).groupBy(*by).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.coalesce(F.avg(usable), F.lit(0.0)) * 100).alias("mape"),
        F.count(F.lit(1)).alias("n"),
    )


def direction_distribution(df: DataFrame, column: str = "direction") -> DataFrame:
    """(direction, count, percentage). The shares are taken over the few groups."""
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    everything = F.sum("count").over(Window.partitionBy(F.lit(0)))
    return counted.withColumn("percentage", F.col("count") / everything * 100)


def prediction_summary(classified: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(metric, value): mean and range of prices, counts and shares of the
    directions, mean confidence. Metrics without rows are left out."""
    rows = F.count(F.lit(1))
    parts: dict[str, Column] = {}
    if "predicted_price" in classified.columns:
        price = F.col("predicted_price")
        parts |= {"avg_predicted_price": F.avg(price), "price_range": F.max(price) - F.min(price)}
    for d in (UP, DOWN, NEUTRAL):
        n = F.count_if(F.col("direction") == d)
        parts |= {
            f"direction_{d.lower()}_count": F.when(n > 0, n.cast("double")),
            f"direction_{d.lower()}_percentage": F.when(n > 0, n / rows * 100),
        }
    if "up_probability" in classified.columns:
        parts["avg_confidence"] = F.avg(confidence())
    wide = classified.groupBy(*by).agg(*[c.alias(n) for n, c in parts.items()])
    return wide.unpivot(list(by), list(parts), "metric", "value").where(F.col("value").isNotNull())


def signal_summary(signals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return signals.groupBy(*by).agg(
        F.count_if(F.col("signal") == UP).alias("up_signals"),
        F.count_if(F.col("signal") == DOWN).alias("down_signals"),
        F.avg("confidence").alias("avg_confidence"),
        F.count_if(F.col("confidence") > HIGH_CONFIDENCE).alias("high_confidence"),
    )


def direction_backtest(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Scores of `direction` and `direction_confident` against `actual_price`.

    A move that did not go up counts as down, as in the classification.
    """
    actual = F.when(F.col("actual_price") > F.col("current_price"), UP).otherwise(DOWN)
    known = df.where(
        F.col("actual_price").isNotNull()
        & F.col("current_price").isNotNull()
        & F.col("direction").isNotNull()
    ).withColumn("actual", actual)
    said, was = F.col("direction"), F.col("actual")
    sure = F.col("direction_confident").isin(UP, DOWN)
    wide = known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count_if(said == was).alias("__right"),
        F.count_if(sure).alias("confident_predictions"),
        F.count_if(sure & (F.col("direction_confident") == was)).alias("__sure_right"),
        *[
            e
            for d in (UP, DOWN)
            for e in (
                F.count_if((said == d) & (was == d)).alias(f"__hit_{d}"),
                F.count_if(said == d).alias(f"__said_{d}"),
                F.count_if(was == d).alias(f"__was_{d}"),
            )
        ],
    )
    scores = {
        "overall_accuracy": ratio(F.col("__right"), F.col("total_predictions")),
        "confident_accuracy": ratio(F.col("__sure_right"), F.col("confident_predictions")),
    }
    for d in (UP, DOWN):
        hit, low = F.col(f"__hit_{d}"), d.lower()
        scores |= {
            f"precision_{low}": ratio(hit, F.col(f"__said_{d}")),
            f"recall_{low}": ratio(hit, F.col(f"__was_{d}")),
            f"f1_{low}": ratio(2 * hit, F.col(f"__said_{d}") + F.col(f"__was_{d}")),
        }
    return wide.select(
        *by, "total_predictions", "confident_predictions", *[c.alias(n) for n, c in scores.items()]
    )
