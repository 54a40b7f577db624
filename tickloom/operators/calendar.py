"""The daily calendar table and its alignment to bars."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import dates

CALENDAR_COLUMNS = [
    "fed_meeting",
    "days_to_fed_meeting",
    "days_since_fed_meeting",
    "earnings_season",
    "employment_report",
    "cpi_release",
    "gdp_release",
    "jobless_claims",
    "market_holiday",
    "half_day_trading",
    "options_expiration",
]

#: A day table of at most this many rows (five centuries) is broadcast.
BROADCAST_DAYS = 200_000


def day_span(df: DataFrame, time: str) -> tuple[dt.date, dt.date]:
    """First and last day of a table, one aggregate over one column."""
    first, last = df.agg(F.min(F.to_date(time)), F.max(F.to_date(time))).first()
    if first is None:
        raise ValueError("no rows to take a date range from")
    return first, last


def day_table(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """One row per day from start to end."""
    days = (end - start).days + 1
    return spark.range(days).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("day"))


def event_columns(
    day: Column, start: Column, end: Column, meeting_dates: list[dt.date] | None = None
) -> dict[str, Column]:
    held = (
        dates.meetings(day, start, end)
        if meeting_dates is None
        else dates.listed_meetings(day, meeting_dates)
    )
    return {
        **held,
        "earnings_season": dates.earnings_season(day),
        **dates.releases(day),
        "market_holiday": dates.market_holiday(day),
        "half_day_trading": dates.half_day(day),
        "options_expiration": dates.options_expiration(day),
    }


def economic_calendar(
    spark: SparkSession,
    start: dt.date,
    end: dt.date,
    meeting_dates: list[dt.date] | None = None,
) -> DataFrame:
    """Day table with the eleven event columns."""
    columns = event_columns(F.col("day"), F.lit(start), F.lit(end), meeting_dates)
    return day_table(spark, start, end).withColumns(columns)


def _small(days: DataFrame, count: int) -> DataFrame:
    return F.broadcast(days) if count <= BROADCAST_DAYS else days


def with_calendar(
    df: DataFrame,
    time: str,
    *,
    nearest: bool,
    meeting_dates: list[dt.date] | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Rows with the calendar of their day.

    nearest=False takes the day of the time, as intraday rows need it.
    nearest=True takes the closest midnight, noon going up, and not past the
    last day, for daily rows. `source` is a cheaper table with the same times,
    to take the date range from.
    """
    source = df if source is None else source
    start, end = day_span(source, time)
    count = (end - start).days + 1
    day = F.to_date(time)
    if nearest:
        day = F.least(F.to_date(F.col(time) + F.expr("INTERVAL '12' HOUR")), F.lit(end))
    calendar = economic_calendar(df.sparkSession, start, end, meeting_dates)
    return (
        df.withColumn("__day", day)
        .join(_small(calendar.withColumnRenamed("day", "__day"), count), "__day", "left")
        .drop("__day")
    )
