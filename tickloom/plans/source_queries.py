"""Queries and SQL for parsers of landed documents, sinks, checks and streams.

The documents are made by Spark from the test tables, in the form the vendor
lands them, and parsed back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators.signals import classify, trading_signals
from tickloom.plans import shapes
from tickloom.plans.news_queries import ORACLES as NEWS_SQL
from tickloom.plans.present import present, sql_real
from tickloom.plans.signal_queries import ORACLES as SIGNAL_SQL
from tickloom.plans.signal_queries import _predictions
from tickloom.plans.sql_parts import ARTICLES, DAILY, HOURLY_BARS, final
from tickloom.session import scratch_path
from tickloom.sources import landed as L
from tickloom.sources import tables as T
from tickloom.sources.merge import merge_rows
from tickloom.streaming import flows as R

BAR_REAL = ["open", "high", "low", "close", "volume"]


def _text(name: str):
    return F.col(name).cast("string")


def _price_documents(bars, time: str = "bar_ts", month: str | None = "yyyy-MM"):
    """One document per (symbol, month), or per (symbol, part): a map of time to numbered fields."""
    fields = F.create_map(
        *[
            x
            for i, c in enumerate(BAR_REAL, 1)
            for x in (F.lit(f"{i}. {c}"), _text(c) if c in bars.columns else F.lit("0"))
        ]
    )
    entry = F.struct(_text(time).alias("k"), fields.alias("v"))
    body = F.to_json(F.map_from_entries(F.collect_list(entry)))
    meta = F.format_string('{"Meta Data": {"2. Symbol": "%s"}, "Time Series (60min)": %s}', "symbol", body)
    part = F.date_format(time, month) if month else F.col("part")
    return bars.groupBy("symbol", part.alias("month")).agg(meta.alias("doc"))


def _prices(spark, folder):
    docs = _price_documents(shapes.hourly_bars(spark, folder)).select("symbol", "doc")
    return present(L.parse_prices(docs)[0])


def _rejected(spark, folder):
    """Documents without a series are set apart: those of one symbol here."""
    docs = _price_documents(shapes.hourly_bars(spark, folder))
    broken = F.when(
        F.col("symbol") == "error", F.regexp_replace("doc", "Time Series", "Note")
    ).otherwise(F.col("doc"))
    bad = L.parse_prices(docs.withColumn("doc", broken))[1]
    return bad.groupBy("symbol").agg(F.count(F.lit(1)).alias("documents"))


def _rejected_entries(spark, folder):
    """Entries with an unreadable time or number are set apart, one by one."""
    # an entry with a broken time has a document of its own, since a map has each key once
    bars = shapes.hourly_bars(spark, folder).withColumn("part", F.date_format("bar_ts", "yyyy-MM-dd-HH"))
    broken = bars.withColumns(
        {
            "bar_ts": F.when(F.hour("bar_ts") == 3, F.lit("not a time")).otherwise(_text("bar_ts")),
            "close": F.when(F.hour("bar_ts") == 5, F.lit("n/a")).otherwise(_text("close")),
        }
    )
    docs = _price_documents(broken, month=None)
    rows, bad = L.parse_prices(docs.select("symbol", "doc"))
    read = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))
    apart = bad.where("entry IS NOT NULL").groupBy("symbol").agg(F.count(F.lit(1)).alias("entries"))
    return read.join(apart, "symbol", "left")


def _indicators(spark, folder):
    wide = shapes.indicator_bars(spark, folder)
    fields = F.create_map(F.lit("Technical RSI"), _text("rsi"), F.lit("MACD"), _text("macd"))
    entry = F.struct(_text("bar_ts").alias("k"), fields.alias("v"))
    body = F.to_json(F.map_from_entries(F.collect_list(entry)))
    doc = F.format_string('{"Meta Data": {"1: Symbol": "x"}, "Technical Analysis": %s}', body)
    docs = wide.groupBy("symbol", F.date_format("bar_ts", "yyyy-MM")).agg(doc.alias("doc"))
    return present(L.parse_indicators(docs.select("symbol", "doc"))[0])


def _news(spark, folder):
    """Documents of up to 1,000 articles, as the vendor limits them."""
    news = shapes.articles(spark, folder)
    item = F.struct(
        _text("article_id").alias("title"),
        F.date_format("time_published", "yyyyMMdd'T'HHmmss").alias("time_published"),
        F.array(F.struct(F.lit("markets").alias("topic"))).alias("topics"),
        "overall_sentiment_score",
        "overall_sentiment_label",
    )
    docs = news.groupBy("symbol", F.floor(F.col("article_id") / 1000).alias("part")).agg(
        F.format_string('{"items": "x", "feed": %s}', F.to_json(F.collect_list(item))).alias("doc")
    )
    df = L.parse_news(docs.select("symbol", "doc"))[0]
    return present(
        df.select(
            "time_published",
            "symbol",
            F.col("title").cast("long").alias("article_id"),
            F.size("topics").alias("topics"),
            "overall_sentiment_score",
            "overall_sentiment_label",
        )
    )


def _daily(spark, folder):
    daily = shapes.daily_closes(spark, folder).withColumnRenamed("series", "symbol")
    docs = _price_documents(daily, "day", "yyyy").select("symbol", "doc")
    return present(L.parse_daily(docs)[0])


def _monthly(spark, folder):
    """Written twice, as a repeated run would, and read back by month."""
    path = scratch_path(spark, "monthly")
    bars = shapes.order_bars(spark, folder)
    T.write_monthly(bars, path)
    T.write_monthly(bars.where("bar_ts >= '1998-01-01'"), path)
    df = spark.read.parquet(path)
    return df.groupBy("symbol", _text("month").alias("month")).agg(F.count(F.lit(1)).alias("bars"))


def _appended(spark, folder):
    """The same news landed twice: kept once by key."""
    path = scratch_path(spark, "news")
    news = shapes.articles(spark, folder)
    for _ in range(2):
        merge_rows(news, path, ["symbol", "article_id"], "time_published")
    df = spark.read.parquet(path)
    return df.groupBy("overall_sentiment_label").agg(F.count(F.lit(1)).alias("articles"))


def _merged(spark, folder):
    """News landed in three parts, the last one corrected and with old news again: merged by
    key, the latest load counts."""
    path = scratch_path(spark, "merged-news")
    news = shapes.articles(spark, folder).withColumn("loaded", F.lit(0))
    half = F.col("article_id") % 2 == 0
    corrected = news.where(F.col("article_id") % 3 == 0).withColumns({"loaded": F.lit(1), "overall_sentiment_label": F.lit("Corrected")})
    for part in (news.where(half), news, corrected, news.where(half)):
        merge_rows(part, path, ["symbol", "article_id"], "time_published", prefer="loaded")
    df = spark.read.parquet(path)
    return df.groupBy(_text("month").alias("month"), "overall_sentiment_label").agg(F.count(F.lit(1)).alias("articles"))


def _csv(spark, folder):
    """All bars through CSV, with a broken line in a file of its own that is set apart."""
    path = scratch_path(spark, "csv")
    named = shapes.hourly_bars(spark, folder).select("symbol", F.col("bar_ts").alias("datetime"), *BAR_REAL)
    named.write.option("header", True).csv(path)
    broken = named.limit(1).select("symbol", F.lit("no time").alias("datetime"), *BAR_REAL)
    broken.write.mode("append").option("header", True).csv(path)
    rows, bad = T.read_csv(spark, path, f"symbol string, {T.BAR_SCHEMA}")
    return present(rows.withColumn("bad_lines", F.lit(bad.count())))


def _tables(spark, folder):
    path = scratch_path(spark, "table")
    T.write_table(shapes.hourly_bars(spark, folder), path)
    return present(T.read_parquet(spark, path, ["symbol", "bar_ts", "close"]))


def _one_csv(spark, folder):
    path = scratch_path(spark, "small")
    T.write_csv(shapes.hourly_bars(spark, folder).groupBy("symbol").count(), path, files=1)
    return spark.read.schema("symbol string, bars bigint").option("header", True).csv(path)


def _documents(spark, folder):
    path = scratch_path(spark, "documents")
    facts = shapes.hourly_bars(spark, folder).groupBy("symbol").agg(
        F.struct(F.count(F.lit(1)).alias("bars"), F.max("high").alias("top")).alias("facts")
    )
    T.write_document(facts, path)
    df = T.read_document(spark, path, "symbol string, facts struct<bars bigint, top double>")
    return present(df.select("symbol", "facts.*"))


def _validated(spark, folder):
    bars = T.validate_bars(shapes.hourly_bars(spark, folder))
    return present(T.validation_report(bars))


def _runs(spark, folder):
    """Two runs side by side, the second written twice; the newest is read."""
    path = scratch_path(spark, "runs")
    bars = shapes.hourly_bars(spark, folder)
    T.append_run(bars.where("symbol = 'view'"), path, "20240101_000000")
    for _ in range(2):
        T.append_run(bars, path, "20240102_000000")
    df = T.latest_run(spark.read.parquet(path))
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))


EVENT_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)


def _event_stream(spark, folder):
    return (
        spark.readStream.schema(EVENT_SCHEMA)
        .option("pathGlobFilter", "events.parquet")
        .parquet(folder)
    )


def _run(stream, path: str) -> None:
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", f"{path}-state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _bar_stream(spark, folder):
    """All slots: those the stream closed, and the closing step over its source."""
    path = scratch_path(spark, "bars")
    _run(R.streaming_bars(_event_stream(spark, folder), entity="event_type", step="1 hour"), path)
    events = shapes.table(spark, folder, "events")
    R.closing_bars(events, entity="event_type", step="1 hour").write.mode("append").parquet(path)
    return present(_written(spark, path))


def _written(spark, path):
    """All Parquet files of a folder; the stream's log does not list the appended ones."""
    schema = spark.read.parquet(path).schema
    return spark.read.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{path}/*.parquet")


def _batch_news(spark, folder):
    """News in two landings, with the later bars landing after the first of them."""
    news, bars = shapes.articles(spark, folder), shapes.session_bars(spark, folder)
    landing, held, out = (scratch_path(spark, n) for n in ("news-landing", "bars-landing", "mapped-news"))
    middle = bars.agg(F.expr("percentile_approx(unix_micros(CAST(bar_ts AS TIMESTAMP)), 0.5)")).first()[0]
    late = F.unix_micros(F.col("bar_ts").cast("timestamp")) > middle
    for number, part in enumerate((~late, late)):
        bars.where(part).write.mode("append").parquet(held)
        news.where(F.col("article_id") % 2 == number).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(news.schema).parquet(landing)
        R.map_each_batch(stream, lambda: spark.read.parquet(held), out, f"{out}-state", available_now=True).awaitTermination()
    R.map_pending(news, spark.read.parquet(held), out, 1)
    return present(spark.read.parquet(out).select("article_id", "bar_ts"))


def _shuffled_bars(spark, folder):
    """News and bars in three landings: every other bar of a landing's hours comes one landing
    late, so news finds a later bar first. What is written equals the batch result."""
    news, bars = shapes.articles(spark, folder), shapes.session_bars(spark, folder)
    landing, held, out = (scratch_path(spark, n) for n in ("news-landing", "bars-landing", "mapped-news"))
    micros = F.unix_micros(F.col("bar_ts").cast("timestamp"))
    low, high = bars.agg(F.min(micros), F.max(micros)).first()
    third = F.least(F.lit(2), F.floor((micros - low) * 3 / F.lit(high - low + 1))).cast("int")
    late = F.when(F.floor(micros / 300_000_000) % 2 == 1, 1).otherwise(0)
    span = f"{(high - low) // 1_000_000} seconds"
    for number in range(4):
        bars.where(third + late == number).write.mode("append").parquet(held)
        news.where(F.col("article_id") % 4 == number).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(news.schema).parquet(landing)
        R.map_each_batch(stream, lambda: spark.read.parquet(held), out, f"{out}-state", True, span).awaitTermination()
    R.map_pending(news, spark.read.parquet(held), out, 3)
    return present(spark.read.parquet(out).select("article_id", "bar_ts"))


def _event_news(events):
    k = F.get_json_object("props", "$.k").cast("int")
    score = (k - 50) / F.lit(50.0)
    return events.select(
        F.col("event_type").alias("symbol"),
        F.col("ts").alias("time_published"),
        score.alias("overall_sentiment_score"),
        F.when(score >= 0.2, "Bullish").when(score <= -0.2, "Bearish").otherwise("Neutral").alias(
            "overall_sentiment_label"
        ),
    )


def _news_stream(spark, folder):
    """All slots: those the stream closed, and the closing step over its source."""
    path = scratch_path(spark, "slots")
    _run(R.streaming_news(_event_news(_event_stream(spark, folder))), path)
    R.closing_news(_event_news(shapes.table(spark, folder, "events"))).write.mode("append").parquet(path)
    return present(_written(spark, path))


def _watched(spark, folder):
    landing, out = scratch_path(spark, "signals"), scratch_path(spark, "summaries")
    signals = trading_signals(classify(_predictions(spark, folder)), ["step"])
    signals.write.option("header", True).csv(landing)

    def report(summary, number):
        summary.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = R.watch_signals(spark, landing, report, f"{out}-state", available_now=True)
    query.awaitTermination()
    return present(spark.read.parquet(out).drop("batch"))


QUERIES = {
    "a01_price_documents": _prices,
    "a01_rejected_documents": _rejected,
    "a01_rejected_entries": _rejected_entries,
    "a02_indicator_documents": _indicators,
    "a03_news_documents": _news,
    "a04_daily_series": _daily,
    "a05_monthly_sink": _monthly,
    "a06_append_sink": _appended,
    "a06_merge_sink": _merged,
    "a07_csv_scan": _csv,
    "a08_table_sink": _tables,
    "a08_single_csv": _one_csv,
    "a09_json_documents": _documents,
    "a10_input_validation": _validated,
    "a11_latest_run": _runs,
    "r01_signal_watcher": _watched,
    "r02_streaming_news": _news_stream,
    "r03_streaming_bars": _bar_stream,
    "r04_news_each_batch": _batch_news,
    "r04_news_late_bars": _shuffled_bars,
}

ORACLES = {
    "a01_price_documents": f"WITH {HOURLY_BARS} " + final("bars", ["bar_ts"], BAR_REAL, ["symbol"]),
    "a01_rejected_documents": "SELECT 'error' AS symbol, count(DISTINCT date_trunc('month', ts)) AS documents "
    "FROM events WHERE event_type = 'error'",
    "a01_rejected_entries": f"WITH {HOURLY_BARS} SELECT symbol, count(*) FILTER (hour(bar_ts) NOT IN (3, 5)) AS bars, "
    "count(*) FILTER (hour(bar_ts) IN (3, 5)) AS entries FROM bars GROUP BY 1",
    "a03_news_documents": f"WITH {ARTICLES} SELECT "
    "CAST(date_trunc('second', time_published) AS VARCHAR) AS time_published, symbol, article_id, "
    f"CAST(1 AS INTEGER) AS topics, {sql_real('score', 'overall_sentiment_score')}, "
    "label AS overall_sentiment_label FROM articles",
    "a04_daily_series": f"WITH {DAILY} " + final("daily", ["day"], ["close"], ["series"]),
    "a05_monthly_sink": "SELECT o_orderpriority AS symbol, strftime(o_orderdate, '%Y-%m') AS month, "
    "count(DISTINCT o_orderdate) AS bars FROM orders GROUP BY 1, 2",
    "a06_append_sink": f"WITH {ARTICLES} SELECT label AS overall_sentiment_label, count(*) AS articles "
    "FROM articles GROUP BY 1",
    "a06_merge_sink": f"WITH {ARTICLES} SELECT strftime(time_published, '%Y-%m') AS month, "
    "CASE WHEN article_id % 3 = 0 THEN 'Corrected' ELSE label END AS overall_sentiment_label, count(*) AS articles "
    "FROM articles GROUP BY 1, 2",
    "a07_csv_scan": f"WITH {HOURLY_BARS}, v AS (SELECT *, bar_ts AS datetime, 1 AS bad_lines FROM bars) "
    + final("v", ["datetime"], BAR_REAL, ["symbol", "bad_lines"]),
    "a08_table_sink": f"WITH {HOURLY_BARS} " + final("bars", ["bar_ts"], ["close"], ["symbol"]),
    "a08_single_csv": f"WITH {HOURLY_BARS} SELECT symbol, count(*) AS bars FROM bars GROUP BY 1",
    "a09_json_documents": f"WITH {HOURLY_BARS} SELECT symbol, count(*) AS bars, {sql_real('max(high)', 'top')} "
    "FROM bars GROUP BY 1",
    "a10_input_validation": f"WITH {HOURLY_BARS} SELECT count(*) AS rows, CAST(min(bar_ts) AS VARCHAR) AS first_ts, "
    "CAST(max(bar_ts) AS VARCHAR) AS last_ts, '' AS missing_columns FROM bars",
    "a11_latest_run": f"WITH {HOURLY_BARS} SELECT symbol, count(*) AS bars FROM bars GROUP BY 1",
    "r02_streaming_news": """WITH n AS (
  SELECT event_type AS symbol, time_bucket(INTERVAL '5 minutes', ts) AS slot,
         (CAST(json_extract(props, '$.k') AS INTEGER) - 50) / 50.0::DOUBLE AS score FROM events),
g AS (SELECT symbol, slot, CAST(sum(CAST(score AS DECIMAL(20, 12))) AS DOUBLE) / count(score) AS sent_mean,
             max(abs(score)) AS sent_max_abs, count(*) FILTER (score >= 0.2) AS bullish_cnt,
             count(*) FILTER (score <= -0.2) AS bearish_cnt, count(*) AS headline_count
      FROM n GROUP BY 1, 2) """
    + final("g", ["slot"], ["sent_mean", "sent_max_abs"], ["symbol", "bullish_cnt", "bearish_cnt", "headline_count"]),
    "r03_streaming_bars": f"WITH {HOURLY_BARS} "
    + final("bars", ["bar_ts"], BAR_REAL, ["symbol"]),
    "r04_news_late_bars": f"SELECT * FROM ({NEWS_SQL['j01_news_to_bar']}) WHERE bar_ts IS NOT NULL",
    "r04_news_each_batch": f"SELECT * FROM ({NEWS_SQL['j01_news_to_bar']}) WHERE bar_ts IS NOT NULL",
    "r01_signal_watcher": "SELECT count(*) FILTER (signal = 'UP') AS up_signals, "
    "count(*) FILTER (signal = 'DOWN') AS down_signals, "
    + sql_real("avg(confidence)", "avg_confidence")
    + f", count(*) FILTER (confidence > 0.8) AS high_confidence FROM ({SIGNAL_SQL['d05_trading_signals']})",
}
ORACLES["a02_indicator_documents"] = (
    f"WITH w AS ({NEWS_SQL['a13_full_bar_table']}) "
    "SELECT symbol, 'RSI' AS indicator, bar_ts, rsi AS value FROM w "
    "UNION ALL SELECT symbol, 'MACD', bar_ts, macd FROM w"
)
