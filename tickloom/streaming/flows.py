"""Structured Streaming forms: bars from ticks, news per slot, signal watcher."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.operators.bars import bar_columns
from tickloom.operators.metrics import signal_summary
from tickloom.operators.news import map_to_bars, partial_sums
from tickloom.session import materialise

SIGNAL_SCHEMA = (
    "step int, signal string, confidence double, strength string, price_target double, "
    "change_percent double"
)


def _timed(df: DataFrame, time: str) -> DataFrame:
    """Watermarks exist for zoned timestamps only, the library's are without."""
    return df.withColumn(time, F.col(time).cast("timestamp"))


def _start() -> Column:
    return F.col("window.start").cast("timestamp_ntz")


def still_open(rows: DataFrame, time: str, step: str, lateness: str) -> DataFrame:
    """The rows of slots that a stream over these rows leaves open: the watermark,
    `lateness` before the latest row, has not reached the slot's end. The closing step of
    a finished stream is `closing_bars` or `closing_news` over its source, appended
    to what the stream wrote."""
    rows = _timed(rows, time)
    latest = rows.agg(F.max(time)).first()[0]
    if latest is None:
        return rows
    return rows.where(F.window(time, step).end > F.lit(latest) - F.expr(f"INTERVAL {lateness}"))


def _bars(ticks: DataFrame, entity: str, time: str, value: str, step: str) -> DataFrame:
    return (
        ticks.groupBy(F.col(entity).alias("symbol"), F.window(time, step))
        .agg(*bar_columns(time, value))
        .select("symbol", _start().alias("bar_ts"), "open", "high", "low", "close", "volume")
    )


def streaming_bars(
    ticks: DataFrame,
    *,
    entity: str = "symbol",
    time: str = "ts",
    value: str = "value",
    step: str = "5 minutes",
    lateness: str = "1 hour",
) -> DataFrame:
    """Bars of closed slots; ticks later than the watermark are dropped."""
    return _bars(_timed(ticks, time).withWatermark(time, lateness), entity, time, value, step)


def closing_bars(
    ticks: DataFrame,
    *,
    entity: str = "symbol",
    time: str = "ts",
    value: str = "value",
    step: str = "5 minutes",
    lateness: str = "1 hour",
) -> DataFrame:
    """Bars of the slots that `streaming_bars` over all these ticks did not close."""
    return _bars(still_open(ticks, time, step, lateness), entity, time, value, step)


def _slots(news: DataFrame, published: str, score: str, label: str, step: str) -> DataFrame:
    return (
        news.groupBy("symbol", F.window(published, step))
        .agg(*partial_sums(F.col(score), F.col(label)))
        .select(
            "symbol",
            _start().alias("slot"),
            F.try_divide(F.col("__sum").cast("double"), F.col("__scored")).alias("sent_mean"),
            F.col("__max").alias("sent_max_abs"),
            F.coalesce("__bull", F.lit(0)).alias("bullish_cnt"),
            F.coalesce("__bear", F.lit(0)).alias("bearish_cnt"),
            F.col("__all").alias("headline_count"),
        )
    )


def streaming_news(
    news: DataFrame,
    *,
    published: str = "time_published",
    score: str = "overall_sentiment_score",
    label: str = "overall_sentiment_label",
    step: str = "5 minutes",
    lateness: str = "1 hour",
) -> DataFrame:
    """Sentiment and counts per tumbling slot. The session rules of
    `news_per_bar` need the bars and run per batch, see `map_each_batch`."""
    return _slots(_timed(news, published).withWatermark(published, lateness), published, score, label, step)


def closing_news(
    news: DataFrame,
    *,
    published: str = "time_published",
    score: str = "overall_sentiment_score",
    label: str = "overall_sentiment_label",
    step: str = "5 minutes",
    lateness: str = "1 hour",
) -> DataFrame:
    """The slots that `streaming_news` over all this news did not close."""
    return _slots(still_open(news, published, step, lateness), published, score, label, step)


def start_each_batch(
    stream: DataFrame,
    work: Callable[[DataFrame, int], None],
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Run a batch function over every micro-batch."""
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def map_each_batch(
    news: DataFrame,
    bars: Callable[[], DataFrame],
    out: str,
    checkpoint: str,
    available_now: bool = False,
    bars_lateness: str = "1 hour",
) -> StreamingQuery:
    """Landed news mapped to bars by the session rules, batch by batch.

    `bars` reads the bars that have landed so far, anew for each batch. A bar is at
    most `bars_lateness` of event time behind the latest bar of its symbol when it
    lands. News keeps waiting in `{out}-pending` while a bar that is still to come could
    be nearer than the one found, or where none is found, and is tried again with
    the next batch; `map_pending` closes a finished stream. So what is written is what
    the batch form gives, in whatever order the bars land. Writing each batch under
    its number keeps a repeated batch from doubling rows.
    """

    def work(batch: DataFrame, number: int) -> None:
        waiting = _pending(batch.sparkSession, out, number - 1, batch)
        _map_batch(batch.unionByName(waiting), bars(), out, number, bars_lateness)

    return start_each_batch(news, work, checkpoint, available_now)


def _pending(spark: SparkSession, out: str, number: int, like: DataFrame) -> DataFrame:
    if number < 0:
        return like.limit(0)
    return spark.read.schema(like.schema).parquet(f"{out}-pending/batch={number}")


def _map_batch(news: DataFrame, bars: DataFrame, out: str, number: int, lateness: str | None) -> None:
    """Map news; with a lateness, only to bars that the bars' watermark of their symbol has reached."""
    found = map_to_bars(news, bars)
    settled = F.col("bar_ts").isNotNull()
    if lateness is not None:
        reached = bars.groupBy("symbol").agg((F.max("bar_ts") - F.expr(f"INTERVAL {lateness}")).alias("__reached"))
        found = found.join(reached, "symbol", "left")
        settled &= F.coalesce(F.col("bar_ts") <= F.col("__reached"), F.lit(False))
    found = materialise(found.withColumn("__settled", settled), "mapped")
    kept = [c for c in found.columns if c not in ("__reached", "__settled")]
    found.where("__settled").select(*kept).write.mode("overwrite").parquet(f"{out}/batch={number}")
    rest = found.where("NOT __settled").select(*[c for c in kept if c != "bar_ts"])
    rest.write.mode("overwrite").parquet(f"{out}-pending/batch={number}")


def map_pending(news: DataFrame, bars: DataFrame, out: str, number: int) -> None:
    """Close a stream whose bars have all landed: map what waits after batch `number`, as
    batch `number` + 1. `news` gives the schema."""
    _map_batch(_pending(news.sparkSession, out, number, news), bars, out, number + 1, None)


def watch_signals(
    spark: SparkSession,
    folder: str,
    report: Callable[[DataFrame, int], None],
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Call `report` with the summary of every newly landed set of signals."""
    landed = spark.readStream.schema(SIGNAL_SCHEMA).option("header", True).csv(folder)
    return start_each_batch(
        landed, lambda batch, n: report(signal_summary(batch), n), checkpoint, available_now
    )
