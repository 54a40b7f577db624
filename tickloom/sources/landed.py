"""Parsers for landed vendor documents, one JSON text per row.

`read_documents` gives one row per landed file; every parser takes a table
with the document in `doc` (prices and indicators also with its symbol) and
returns parsed rows and, apart, what it cannot use: whole documents in `doc`, and
single entries with an unreadable time or number in `entry`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Markers and time format of the vendor documents.
SERIES_MARK = "Time Series"
META_KEY = "Meta Data"
NEWS_TIME = "yyyyMMdd'T'HHmmss"

NEWS_SCHEMA = """
feed array<struct<
  title string, url string, time_published string, authors array<string>, summary string,
  source string, category_within_source string, source_domain string,
  topics array<struct<topic string, relevance_score string>>,
  overall_sentiment_score double, overall_sentiment_label string,
  ticker_sentiment array<struct<ticker string, relevance_score string,
    ticker_sentiment_score string, ticker_sentiment_label string>>>>
"""

NEWS_FIELDS = (
    "title", "url", "authors", "summary", "source", "category_within_source", "source_domain",
    "topics", "overall_sentiment_score", "overall_sentiment_label", "ticker_sentiment",
)
PRICE_FIELDS = ("open", "high", "low", "close", "volume")


def read_documents(spark: SparkSession, path: str, symbol_pattern: str | None = None) -> DataFrame:
    """Files as (doc, path) rows, with `symbol` taken from the file name by the
    first group of symbol_pattern."""
    docs = spark.read.text(path, wholetext=True).select(
        F.col("value").alias("doc"), F.col("_metadata.file_path").alias("path")
    )
    if symbol_pattern is None:
        return docs
    name = F.element_at(F.split("path", "/"), -1)
    return docs.withColumn("symbol", F.regexp_extract(name, symbol_pattern, 1))


def _top(docs: DataFrame, wanted) -> DataFrame:
    """Adds `__body`: the JSON text below the first wanted top-level key."""
    held = F.from_json("doc", "map<string,string>")
    key = F.get(F.filter(F.map_keys("__top"), wanted), F.lit(0))
    return (
        docs.withColumn("__top", held)
        .withColumn("__key", key)
        .withColumn("__body", F.try_element_at("__top", F.col("__key")))
    )


def _bare(name: Column, mark: str) -> Column:
    """Second word of a field name where it has one."""
    return F.coalesce(F.get(F.split(name, mark), F.lit(1)), name)


def _rows(docs: DataFrame, wanted, mark: str) -> tuple[DataFrame, DataFrame]:
    top = _top(docs, wanted)
    body = F.from_json("__body", "map<string,map<string,string>>")
    parsed = top.withColumn("__rows", body)
    helpers = ["__top", "__key", "__body", "__rows"]
    bad = parsed.where(F.col("__rows").isNull()).drop(*helpers)
    rows = (
        parsed.where(F.col("__rows").isNotNull())
        .select(*docs.columns, F.explode("__rows").alias("__ts", "__fields"))
        .withColumn("__fields", F.transform_keys("__fields", lambda k, _: _bare(k, mark)))
        .drop("doc")
    )
    return rows, bad


def _raw(rows: DataFrame, texts: dict[str, Column]) -> list[Column]:
    """Helper columns of an entry: its text, and which fields held one."""
    entry = F.to_json(F.struct(F.col("__ts").alias("time"), *[t.alias(n) for n, t in texts.items()]))
    return [entry.alias("__entry"), *[t.isNotNull().alias(f"__held_{n}") for n, t in texts.items()]]


def _split(read: DataFrame, time: str, fields: Sequence[str], bad: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable rows, and documents and entries that are not. An entry is rejected if
    its time or a number that it has does not parse; an absent number is missing."""
    broken = F.col(time).isNull()
    for n in fields:
        broken = broken | (F.col(f"__held_{n}") & F.col(n).isNull())
    helpers = ["__entry", *[f"__held_{n}" for n in fields]]
    unread = read.where(broken).select("symbol", F.col("__entry").alias("entry"))
    return read.where(~broken).drop(*helpers), bad.unionByName(unread, allowMissingColumns=True)


def parse_prices(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbol, bar_ts, open, high, low, close, volume) and rejected documents."""
    rows, bad = _rows(docs, lambda k: k.contains(SERIES_MARK), r"\. ")
    texts = {n: F.try_element_at("__fields", F.lit(n)) for n in PRICE_FIELDS}
    fields = [t.try_cast("double").alias(n) for n, t in texts.items()]
    read = rows.select("symbol", F.col("__ts").try_cast("timestamp_ntz").alias("bar_ts"), *fields, *_raw(rows, texts))
    return _split(read, "bar_ts", PRICE_FIELDS, bad)


def parse_daily(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(series, day, close) from daily price documents; `symbol` names the series."""
    bars, bad = parse_prices(docs)  # the rejects are those of the bars
    return bars.select(F.col("symbol").alias("series"), F.to_date("bar_ts").alias("day"), "close"), bad


def parse_indicators(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbol, indicator, bar_ts, value); a document without a body is an
    empty month and gives no rows."""
    rows, bad = _rows(docs, lambda k: k != META_KEY, " ")
    long = rows.select("symbol", "__ts", F.explode("__fields").alias("indicator", "__text"))
    read = long.select(
        "symbol",
        "indicator",
        F.col("__ts").try_cast("timestamp_ntz").alias("bar_ts"),
        F.col("__text").try_cast("double").alias("value"),
        *_raw(long, {"value": F.col("__text")}),
    )
    return _split(read, "bar_ts", ("value",), bad)


def parse_news(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per article with its nested fields, and rejected documents."""
    parsed = docs.withColumn("__feed", F.from_json("doc", NEWS_SCHEMA)["feed"])
    bad = parsed.where(F.col("__feed").isNull()).drop("__feed")
    articles = parsed.where(F.col("__feed").isNotNull()).select("symbol", F.explode("__feed").alias("a"))
    published = F.try_to_timestamp("a.time_published", F.lit(NEWS_TIME)).cast("timestamp_ntz")
    read = articles.select("symbol", "a.*", published.alias("__published"))
    kept = read.where(F.col("__published").isNotNull())
    unread = read.where(F.col("__published").isNull()).select("symbol", F.to_json(F.struct("title", "time_published")).alias("entry"))
    return kept.select(F.col("__published").alias("time_published"), "symbol", *NEWS_FIELDS), bad.unionByName(
        unread, allowMissingColumns=True
    )
