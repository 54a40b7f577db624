"""Market-shaped tables derived from the test tables, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import rolling as R
from tickloom.functions.numeric import ratio
from tickloom.operators.bars import bars_from_ticks, grid_bound
from tickloom.operators.recipe import Level, Recipe, add_features
from tickloom.operators.series import Frames, Series

HOUR, FIVE_MINUTES = 3600, 300


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def hourly_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly bars of `events.value`, one symbol per event type."""
    return bars_from_ticks(
        table(spark, folder, "events"), entity="event_type", step="1 hour"
    )


def hourly_series(spark: SparkSession, folder: str) -> Series:
    bound = grid_bound(table(spark, folder, "events"), HOUR)
    return Series(("symbol",), "bar_ts", max_rows=bound)


def session_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Five-minute weekday bars, 04:00 to 19:55, of three symbols."""
    events = table(spark, folder, "events")
    traded = events.where(
        (F.col("event_type") != "error")
        & (F.weekday("ts") < 5)
        & F.hour("ts").between(4, 19)
    )
    return bars_from_ticks(traded, entity=_traded_symbol(), step="5 minutes")


def _traded_symbol():
    return F.concat(F.lit("S"), (F.col("user_id") % 3).cast("string"))


def session_series(spark: SparkSession, folder: str) -> Series:
    bound = grid_bound(table(spark, folder, "events"), FIVE_MINUTES)
    return Series(("symbol",), "bar_ts", max_rows=bound)


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """News of the three symbols: error events, scored by their property k."""
    events = table(spark, folder, "events").where(F.col("event_type") == "error")
    k = F.get_json_object("props", "$.k").cast("int")
    score = (k - 50) / F.lit(50.0)
    label = (
        F.when(score >= 0.6, "Bullish")
        .when(score >= 0.2, "Somewhat-Bullish")
        .when(score <= -0.6, "Bearish")
        .when(score <= -0.2, "Somewhat-Bearish")
        .otherwise("Neutral")
    )
    return events.select(
        F.col("event_id").alias("article_id"),
        _traded_symbol().alias("symbol"),
        F.col("ts").alias("time_published"),
        score.alias("overall_sentiment_score"),
        label.alias("overall_sentiment_label"),
    )


def user_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """Irregular ticks of many entities."""
    return table(spark, folder, "events").select("user_id", "ts", "event_id", "value")


USER_SERIES = Series(("user_id",), "ts", ("event_id",))


def daily_closes(spark: SparkSession, folder: str) -> DataFrame:
    """(series, day, close): a volatility index, a dollar index, two yields and
    three sectors from shipped lines."""
    lines = table(spark, folder, "lineitem")
    day = F.to_date("l_shipdate").alias("day")
    indices = (
        lines.groupBy(day)
        .agg(
            (20 + 1000 * (F.avg("l_discount") - 0.05)).alias("VIX"),
            F.avg("l_quantity").alias("DXY"),
            (100 * F.avg(F.when(F.col("l_linestatus") == "O", F.col("l_tax")))).alias("FVX"),
            (100 * F.avg(F.when(F.col("l_linestatus") == "F", F.col("l_tax")))).alias("TNX"),
        )
        .unpivot("day", ["VIX", "DXY", "FVX", "TNX"], "series", "close")
        .where(F.col("close").isNotNull())
        .select("series", "day", "close")
    )
    price = F.try_divide(F.sum("l_extendedprice"), F.sum("l_quantity"))
    sectors = (
        lines.groupBy(F.concat(F.lit("XL"), F.col("l_returnflag")).alias("series"), day)
        .agg(price.alias("close"))
        .select("series", "day", "close")
    )
    return indices.unionByName(sectors)


SECTORS = ["XLA", "XLN", "XLR"]


def order_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars of order values, one symbol per order priority."""
    orders = table(spark, folder, "orders")
    return bars_from_ticks(
        orders,
        entity="o_orderpriority",
        time="o_orderdate",
        value="o_totalprice",
        at="o_orderkey",
        step="1 day",
    )


def order_series(spark: SparkSession, folder: str) -> Series:
    bound = grid_bound(table(spark, folder, "orders"), 86_400, "o_orderdate")
    return Series(("symbol",), "bar_ts", bucket="month", max_rows=bound)


def indicator_recipe(f: Frames) -> Recipe:
    """Stand-ins for vendor indicators: a 0..100 oscillator and a trend pair."""
    low, high = R.lowest(f, "low", 14), R.highest(f, "high", 14)
    return Recipe(
        ["rsi", "macd", "macd_signal"],
        [
            Level(
                add={
                    "rsi": 100 * ratio(F.col("close") - low, high - low),
                    "macd": R.mean(f, "close", 12) - R.mean(f, "close", 26),
                }
            ),
            Level(add={"macd_signal": R.mean(f, "macd", 9)}),
        ],
        back=34,
    )


def indicator_bars(spark: SparkSession, folder: str) -> DataFrame:
    series = hourly_series(spark, folder)
    return add_features(hourly_bars(spark, folder), series, [indicator_recipe])
