"""News articles to trading bars.

Rules for an article published at t (fixed values: session 04:00 to 20:00,
bars of five minutes):
  before 04:00        the first 04:00 bar on or after that day
  from 20:00 on       the first 04:00 bar on or after the next day
  exactly 04:00:00    as if published at 04:05
  otherwise           the first bar at or after t
Without such a bar the article is unmapped. `compat=True` then falls back to
the first 04:00 bar on or after the article's own day, even if it is earlier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.asof import AT, aligned

SESSION_START = 4
SESSION_END = 20
BULLISH = ("Bullish", "Somewhat-Bullish")
BEARISH = ("Bearish", "Somewhat-Bearish")
COUNTS = ["bullish_cnt", "bearish_cnt", "headline_count"]

NEEDS_OPEN, SEARCH, OWN_DAY = "__needs_open", "__search", "__own_day"


def _open_of(t: Column, days: int = 0) -> Column:
    midnight = F.date_trunc("day", t).cast("timestamp_ntz")
    return midnight + F.expr(f"INTERVAL '{24 * days + SESSION_START}' HOUR")


def _search(published: Column) -> dict[str, Column]:
    early, late = F.hour(published) < SESSION_START, F.hour(published) >= SESSION_END
    at_open = _is_open(published)
    target = (
        F.when(early, _open_of(published))
        .when(late, _open_of(published, days=1))
        .when(at_open, published + F.expr("INTERVAL '5' MINUTE"))
        .otherwise(published)
    )
    return {NEEDS_OPEN: early | late, SEARCH: target}


def _is_open(bar_ts: Column) -> Column:
    return bar_ts == _open_of(bar_ts)


def _first_open(
    rows: DataFrame,
    bars: DataFrame,
    day_open: Column,
    name: str = "bar_ts",
    source: DataFrame | None = None,
) -> DataFrame:
    """Rows with the first 04:00 bar at or after `day_open`, aligned once per
    (symbol, day) however many rows share it. `source` is a cheaper table with
    the same days."""
    marks = bars.where(_is_open(F.col("bar_ts"))).select("symbol", "bar_ts")
    keys = ["symbol", "__from"]
    days = (rows if source is None else source).select("symbol", day_open.alias("__from")).distinct()
    payload = {name: F.col("bar_ts")}
    found = aligned(days, marks, ["symbol"], F.col("__from"), "bar_ts", payload, True, bounded=True)
    return rows.withColumn("__from", day_open).join(found.drop(AT), keys, "left").drop("__from")


def _find_bars(
    points: DataFrame, bars: DataFrame, own_day: str | None, grid_seconds: int | None
) -> DataFrame:
    """Points with `bar_ts`, looked up by their search time in one pass; with
    `own_day` those that find none fall back to an open from their own day on."""
    marks = bars.select("symbol", "bar_ts")
    payload = {
        "__any": F.col("bar_ts"),
        "__open": F.when(_is_open(F.col("bar_ts")), F.col("bar_ts")),
    }
    # grid slots bound the rows of a day; without a grid they are counted
    found = aligned(points, marks, ["symbol"], F.col(SEARCH), "bar_ts", payload, True, bounded=grid_seconds is not None)
    found = found.withColumn(
        "bar_ts", F.when(F.col(NEEDS_OPEN), F.col("__open")).otherwise(F.col("__any"))
    ).drop("__any", "__open", AT)
    if own_day is None:
        return found
    found = _first_open(found, bars, _open_of(F.col(own_day)), "__fallback", points)
    fallback = F.when(~F.col(NEEDS_OPEN), F.col("__fallback"))
    return found.withColumn("bar_ts", F.coalesce("bar_ts", fallback)).drop("__fallback")


def _require_grid(bars: DataFrame, grid_seconds: int | None) -> None:
    """One aggregate over the bar times, if a grid is claimed."""
    if grid_seconds is not None:
        at = F.col("bar_ts").cast("timestamp")
        off = F.unix_micros(at) % F.lit(grid_seconds * 1_000_000) != 0
        if bars.agg(F.count_if(off)).first()[0]:
            raise ValueError(f"bars do not lie on a grid of {grid_seconds} seconds")


def _slot(search: Column, grid_seconds: int) -> Column:
    """First grid time at or after the search time."""
    size = grid_seconds * 1_000_000
    micros = F.unix_micros(search.cast("timestamp"))
    return F.timestamp_micros(F.ceil(micros / F.lit(size)) * size).cast("timestamp_ntz")


def map_to_bars(
    news: DataFrame,
    bars: DataFrame,
    published: str = "time_published",
    *,
    grid_seconds: int | None = None,
    compat: bool = False,
) -> DataFrame:
    """Every article with the bar it belongs to.

    The distinct search times per symbol are aligned, and the articles look
    theirs up by equality, so a time or a symbol with very many articles is
    never ordered in one task. If all bars lie on a fixed grid, `grid_seconds`
    makes the search times grid slots; a bar off the grid is then an error.
    """
    _require_grid(bars, grid_seconds)
    points = _searched(news, published, grid_seconds, compat)
    keys = _search_keys(compat)
    times = points.select(*keys).where(F.col(SEARCH).isNotNull()).distinct()
    found = _find_bars(times, bars, OWN_DAY if compat else None, grid_seconds)
    return points.join(found, keys, "left").drop(*keys[1:])


def _search_keys(compat: bool) -> list[str]:
    return ["symbol", NEEDS_OPEN, SEARCH, *([OWN_DAY] if compat else [])]


def _searched(
    news: DataFrame, published: str, grid_seconds: int | None, compat: bool
) -> DataFrame:
    """News with their search keys; the fallback also needs the article's day."""
    points = news.withColumns(_search(F.col(published)))
    if grid_seconds is not None:
        points = points.withColumn(SEARCH, _slot(F.col(SEARCH), grid_seconds))
    if compat:
        points = points.withColumn(OWN_DAY, F.date_trunc("day", published).cast("timestamp_ntz"))
    return points


def next_session_open(points: DataFrame, bars: DataFrame, at: str) -> DataFrame:
    """Every row with the first 04:00 bar at or after 04:00 of its day."""
    return _first_open(points, bars, _open_of(F.col(at)))


def fold_label(label: Column) -> Column:
    """`Somewhat-` labels counted with their strong form."""
    return (
        F.when(label.isin(*BULLISH), "Bullish").when(label.isin(*BEARISH), "Bearish").otherwise(label)
    )


def partial_sums(score: Column, label: Column) -> list[Column]:
    # decimal sums do not depend on the order of the articles, so a balanced
    # bar has a mean of exactly 0 and the sign flags built on it are stable
    return [
        F.sum(score.cast("decimal(20,12)")).alias("__sum"),
        F.count(score).alias("__scored"),
        F.max(F.abs(score)).alias("__max"),
        F.sum(label.isin(*BULLISH).cast("long")).alias("__bull"),
        F.sum(label.isin(*BEARISH).cast("long")).alias("__bear"),
        F.count(F.lit(1)).alias("__all"),
    ]


def _combined() -> list[Column]:
    return [
        F.try_divide(F.sum("__sum").cast("double"), F.sum("__scored")).alias("sent_mean"),
        F.max("__max").alias("sent_max_abs"),
        F.coalesce(F.sum("__bull"), F.lit(0)).alias("bullish_cnt"),
        F.coalesce(F.sum("__bear"), F.lit(0)).alias("bearish_cnt"),
        F.sum("__all").alias("headline_count"),
    ]


def news_per_bar(
    news: DataFrame,
    bars: DataFrame,
    *,
    published: str = "time_published",
    score: str = "overall_sentiment_score",
    label: str = "overall_sentiment_label",
    grid_seconds: int | None = None,
    compat: bool = False,
) -> DataFrame:
    """Sentiment and counts per (symbol, bar_ts).

    Articles with the same search time share their bar, so they are summed
    before any alignment. If all bars lie on a fixed grid, `grid_seconds` makes the
    search times grid slots, so the aligned table grows with the time line and not
    with the articles; a bar off the grid is then an error.
    """
    _require_grid(bars, grid_seconds)
    points = _searched(news.where(F.col(published).isNotNull()), published, grid_seconds, compat)
    slots = points.groupBy(*_search_keys(compat)).agg(*partial_sums(F.col(score), F.col(label)))
    placed = _find_bars(slots, bars, OWN_DAY if compat else None, grid_seconds)
    return placed.where(F.col("bar_ts").isNotNull()).groupBy("symbol", "bar_ts").agg(*_combined())


def bars_with_news(bars: DataFrame, per_bar: DataFrame) -> DataFrame:
    """All bars; counts are 0 and sentiment stays missing where no news fell."""
    return bars.join(per_bar, ["symbol", "bar_ts"], "left").fillna(0, subset=COUNTS)
