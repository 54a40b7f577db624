"""All registered queries, and the SQL each is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.plans import market_queries, news_queries, prepare_queries, signal_queries, source_queries, technical_queries, training_queries, window_queries

PARTS = (technical_queries, window_queries, news_queries, market_queries, prepare_queries, training_queries, signal_queries, source_queries)

QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES["t01_band_position"](spark, folder)
