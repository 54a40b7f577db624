"""Queries and SQL for alignment, news per bar and sentiment features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators.asof import asof_backward, asof_forward
from tickloom.operators.bars import full_bars
from tickloom.operators.news import (
    bars_with_news,
    fold_label,
    map_to_bars,
    news_per_bar,
    next_session_open,
)
from tickloom.operators.sentiment import COLUMNS, MOVING, sentiment_features
from tickloom.operators.technical import technical_features
from tickloom.plans import shapes
from tickloom.plans.present import present, sql_real
from tickloom.plans.sql_parts import (
    ARTICLES,
    HOURLY_BARS,
    SESSION_BARS,
    div,
    final,
    flag,
    roll,
    roll_quantile,
    windows,
)

KEYS = ["symbol", "bar_ts"]


def news_bars(spark, folder):
    bars = shapes.session_bars(spark, folder)
    return bars_with_news(bars, news_per_bar(shapes.articles(spark, folder), bars, grid_seconds=shapes.FIVE_MINUTES))


def _mapped(compat, grid=300):
    def query(spark, folder):
        news = shapes.articles(spark, folder)
        bars = shapes.session_bars(spark, folder)
        df = map_to_bars(news, bars, grid_seconds=grid, compat=compat)
        return present(df.select("article_id", "bar_ts"))

    return query


def _opens(spark, folder):
    news = shapes.articles(spark, folder)
    df = next_session_open(news, shapes.session_bars(spark, folder), "time_published")
    return present(df.select("article_id", "bar_ts"))


def _per_bar(grid, compat=False):
    def query(spark, folder):
        bars = shapes.session_bars(spark, folder)
        news = shapes.articles(spark, folder)
        return present(news_per_bar(news, bars, grid_seconds=grid, compat=compat))

    return query


def _folded(spark, folder):
    news = shapes.articles(spark, folder)
    return news.groupBy(
        "symbol", fold_label(F.col("overall_sentiment_label")).alias("label")
    ).agg(F.count(F.lit(1)).alias("articles"))


def _last_purchase(spark, folder):
    events = shapes.table(spark, folder, "events")
    marks = events.where(F.col("event_type") == "purchase").select(
        "user_id", F.col("ts").alias("bought_at"), F.col("value").alias("bought")
    )
    df = asof_backward(
        events.select("user_id", "event_id", "ts"),
        marks,
        entity=["user_id"],
        at="ts",
        mark_time="bought_at",
        payload={"bought_at": F.col("bought_at"), "bought": F.col("bought")},
    )
    return present(df.select("event_id", F.unix_micros(F.col("bought_at").cast("timestamp")).alias("bought_at"), "bought"))


def _next_purchase(spark, folder):
    events = shapes.table(spark, folder, "events")
    marks = events.where(F.col("event_type") == "purchase").select(
        "user_id", F.col("ts").alias("bought_at")
    )
    df = asof_forward(
        events.select("user_id", "event_id", "ts"), marks, entity=["user_id"], at="ts", mark_time="bought_at"
    )
    return present(df.select("event_id", F.unix_micros(F.col("bought_at").cast("timestamp")).alias("bought_at")))


def _same_names(spark, folder):
    """Events with the last purchase of their user, both tables with the same column names."""
    events = shapes.table(spark, folder, "events").select("event_id", "user_id", "ts", "value", "event_type")
    marks = events.where(F.col("event_type") == "purchase").drop("event_type")
    df = asof_backward(
        events, marks, entity=["user_id"], at="ts", mark_time="ts", payload={c: F.col(c) for c in ("ts", "value")}
    )
    micros = {c: F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("ts", "ts_mark")}
    return present(df.select("event_id", *micros.values(), "value", "value_mark"))


def _one_second(spark, folder):
    """All events as one entity in one second, with null keys among points and marks."""
    events = shapes.table(spark, folder, "events")
    moment = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("event_id") * 7919 % 1_000_000).cast("timestamp_ntz")
    known = lambda n: F.col("event_id") % n != 0
    points = events.select("event_id", F.when(known(11), "x").alias("entity"), F.when(known(13), moment).alias("at"))
    marks = events.where(F.col("event_type") == "purchase").select(
        F.when(known(5), "x").alias("entity"), F.when(known(7), moment).alias("at"), "value"
    )
    df = asof_backward(points, marks, entity=["entity"], at="at", mark_time="at", payload={"value": F.col("value")})
    return present(df.select("event_id", "value"))


def _all_bars(spark, folder):
    """Landed bars with repeats, every third of which was loaded again with other
    prices, and indicator rows in long form."""
    bars = shapes.hourly_bars(spark, folder)
    wide = shapes.indicator_bars(spark, folder)
    long = wide.select(*KEYS, "rsi", "macd").unpivot(
        KEYS, ["rsi", "macd"], "indicator", "value"
    )
    late = bars.where(F.hour("bar_ts") % 3 == 0).withColumn("close", F.col("close") + 1)
    landed = bars.withColumn("loaded", F.lit(0)).unionByName(late.withColumn("loaded", F.lit(1)))
    landed = landed.unionByName(bars.withColumn("loaded", F.lit(0)))
    return present(full_bars(landed, long, ["rsi", "macd"], F.col("loaded")).drop("loaded"))


def _sentiment(*groups, fill=None, coarse=None):
    def query(spark, folder):
        series = shapes.session_series(spark, folder)
        bars = news_bars(spark, folder)
        df = sentiment_features(bars, series, groups=groups or None, keep=KEYS, fill_missing=fill)
        return present(df, coarse=coarse)

    return query


def _side_by_side(spark, folder):
    """Bar and sentiment features on one frame, without a join of features."""
    series = shapes.session_series(spark, folder)
    bars = technical_features(news_bars(spark, folder), series, groups=["momentum", "sessions"])
    df = sentiment_features(bars, series, groups=["news_intensity", "extreme_sentiment"])
    names = [
        "momentum_5",
        "market_open",
        "news_intensity_12h",
        "extreme_positive_sentiment",
        "headline_count",
    ]
    return present(df.select(*KEYS, *names))


QUERIES = {
    "j01_news_to_bar": _mapped(False),
    "j01_news_to_bar_compat": _mapped(True),
    "j01_news_to_bar_off_grid": _mapped(False, None),
    "j02_next_session_open": _opens,
    "j03_bars_with_news": lambda spark, folder: present(news_bars(spark, folder)),
    "j04_asof_backward": _last_purchase,
    "j04_asof_forward": _next_purchase,
    "j04_asof_same_names": _same_names,
    "j04_asof_one_second": _one_second,
    "j09_features_side_by_side": _side_by_side,
    "g01_news_per_bar": _per_bar(300),
    "g01_news_per_bar_off_grid": _per_bar(None),
    "g01_news_per_bar_compat": _per_bar(300, True),
    "g02_folded_labels": _folded,
    "a13_full_bar_table": _all_bars,
    "n01_rolling_statistics": _sentiment("rolling_statistics"),
    "n01_rolling_statistics_filled": _sentiment("rolling_statistics", fill="ffill"),
    "n02_sentiment_moves": _sentiment("moves"),
    "n03_sentiment_accelerations": _sentiment("accelerations"),
    "n04_smoothed_momentum": _sentiment("smoothed_momentum"),
    "n05_trend_strength": _sentiment("trend_strength"),
    "n06_news_intensity": _sentiment("news_intensity"),
    "n07_news_frequency": _sentiment("news_frequency"),
    "n08_news_burst": _sentiment("news_burst"),
    "n09_news_drought": _sentiment("news_drought"),
    "n10_time_since_news": _sentiment("time_since_news"),
    "n11_sentiment_regimes": _sentiment("sentiment_regimes", fill="zero"),
    "n12_sentiment_volatility": _sentiment("sentiment_volatility", fill="ffill"),
    "n13_extreme_sentiment": _sentiment("extreme_sentiment"),
    "n14_sentiment_persistence": _sentiment("sentiment_persistence"),
    "sentiment_all": _sentiment(),
}

_SEARCH = """
searched AS (
  SELECT *, hour(time_published) < 4 OR hour(time_published) >= 20 AS need_open,
         CASE WHEN hour(time_published) < 4 THEN date_trunc('day', time_published) + INTERVAL '4 hours'
              WHEN hour(time_published) >= 20 THEN date_trunc('day', time_published) + INTERVAL '28 hours'
              WHEN time_published = date_trunc('day', time_published) + INTERVAL '4 hours'
                THEN time_published + INTERVAL '5 minutes'
              ELSE time_published END AS search,
         date_trunc('day', time_published) + INTERVAL '4 hours' AS own_open
  FROM articles),
opens AS (SELECT symbol, bar_ts FROM bars
          WHERE bar_ts = date_trunc('day', bar_ts) + INTERVAL '4 hours')"""


def _mapped_ctes(compat: bool) -> str:
    fallback = (
        "ASOF LEFT JOIN opens p ON s.symbol = p.symbol AND s.own_open <= p.bar_ts" if compat else ""
    )
    other = "coalesce(b.bar_ts, p.bar_ts)" if compat else "b.bar_ts"
    return f"""{SESSION_BARS}, {ARTICLES}, {_SEARCH},
mapped AS (
  SELECT s.*, CASE WHEN s.need_open THEN o.bar_ts ELSE {other} END AS bar_ts
  FROM searched s
  ASOF LEFT JOIN bars b ON s.symbol = b.symbol AND s.search <= b.bar_ts
  ASOF LEFT JOIN opens o ON s.symbol = o.symbol AND s.search <= o.bar_ts
  {fallback})"""


def _per_bar_cte(compat: bool = False) -> str:
    return f"""{_mapped_ctes(compat)},
per_bar AS (
  SELECT symbol, bar_ts,
         CAST(sum(CAST(score AS DECIMAL(20, 12))) AS DOUBLE) / nullif(count(score), 0) AS sent_mean, max(abs(score)) AS sent_max_abs,
         count(*) FILTER (label IN ('Bullish', 'Somewhat-Bullish')) AS bullish_cnt,
         count(*) FILTER (label IN ('Bearish', 'Somewhat-Bearish')) AS bearish_cnt,
         count(*) AS headline_count
  FROM mapped WHERE bar_ts IS NOT NULL GROUP BY 1, 2)"""


_COUNTS = ["bullish_cnt", "bearish_cnt", "headline_count"]
_NEWS_BARS = f"""{_per_bar_cte()},
joined AS (
  SELECT b.*, sent_mean, sent_max_abs, coalesce(bullish_cnt, 0) AS bullish_cnt,
         coalesce(bearish_cnt, 0) AS bearish_cnt, coalesce(headline_count, 0) AS headline_count
  FROM bars b LEFT JOIN per_bar USING (symbol, bar_ts))"""


def _filled_source(fill: str | None) -> str:
    if fill == "zero":
        pick = "coalesce({c}, 0.0)"
    elif fill == "ffill":
        pick = "last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS UNBOUNDED PRECEDING)"
    else:
        pick = "{c}"
    swaps = ", ".join(f"{pick.format(c=c)} AS {c}" for c in ("sent_mean", "sent_max_abs"))
    return f"base AS (SELECT * REPLACE ({swaps}) FROM joined)"


def _sql(steps, sizes, reals, whole=(), fill=None) -> str:
    ctes = [_NEWS_BARS, _filled_source(fill)]
    for name, columns, source in steps:
        ctes.append(f"{name} AS (SELECT *, {columns} FROM {source} {windows(sizes=sizes)})")
    return f"WITH {', '.join(ctes)} " + final(steps[-1][0], ["bar_ts"], reals, ["symbol", *whole])


SIZES = (3, 7, 14, 30)


def _statistics(fill=None) -> str:
    first = []
    for c in COLUMNS:
        for n in SIZES:
            first += [
                f"{roll('avg', c, n)} AS {c}_ma_{n}",
                f"{roll('stddev_samp', c, n)} AS {c}_std_{n}",
                f"{roll('min', c, n)} AS {c}_min_{n}",
                f"{roll('max', c, n)} AS {c}_max_{n}",
                f"{roll_quantile(c, 0.25, n)} AS {c}_q25_{n}",
                f"{roll_quantile(c, 0.75, n)} AS {c}_q75_{n}",
            ]
    second = [
        f"({c} - {c}_ma_{n}) / ({c}_std_{n} + 1e-10) AS {c}_zscore_{n}" for c in COLUMNS for n in SIZES
    ]
    real, whole = [], []
    for c in COLUMNS:
        for n in SIZES:
            for s in ("ma", "std", "min", "max", "q25", "q75", "zscore"):
                counted = c in _COUNTS and s in ("min", "max")
                (whole if counted else real).append(f"{c}_{s}_{n}")
    return _sql(
        [("a", ", ".join(first), "base"), ("b", ", ".join(second), "a")], SIZES, real, whole, fill
    )


def _weighted(held: str, span: int) -> str:
    d = 1 - 2 / (span + 1)
    low = f"list_sum(list_transform({held}, lambda v, i: CASE WHEN v IS NULL THEN 0 ELSE pow({d!r}, len({held}) - i) END))"
    top = f"list_sum(list_transform({held}, lambda v, i: v * pow({d!r}, len({held}) - i)))"
    return f"{top} / nullif({low}, 0)"


def _moves() -> tuple[str, list[str], list[str]]:
    names = [f"{c}_momentum_{p}" for c in MOVING for p in (1, 3, 5, 10)]
    text = ", ".join(
        f"{c} - lag({c}, {p}) OVER e AS {c}_momentum_{p}" for c in MOVING for p in (1, 3, 5, 10)
    )
    return text, [n for n in names if n.startswith("sent")], [n for n in names if not n.startswith("sent")]


def _accelerations() -> tuple[str, list[str], list[str]]:
    names = [f"{c}_acceleration_{p}" for c in MOVING for p in (3, 5, 10)]
    text = ", ".join(
        f"({c} - lag({c}, {p}) OVER e) - (lag({c}, {p}) OVER e - lag({c}, {2 * p}) OVER e) "
        f"AS {c}_acceleration_{p}"
        for c in MOVING
        for p in (3, 5, 10)
    )
    return text, [n for n in names if n.startswith("sent")], [n for n in names if not n.startswith("sent")]


def _regimes(fill: str | None = None) -> str:
    return _sql(
    [
        (
            "a",
            f"{roll_quantile('sent_mean', 0.25, 100)} AS lo, {roll_quantile('sent_mean', 0.75, 100)} AS hi",
            "base",
        ),
        (
            "b",
            f"{flag('sent_mean > hi')} AS sentiment_regime_bullish, "
            f"{flag('sent_mean < lo')} AS sentiment_regime_bearish, "
            f"{flag('sent_mean >= lo AND sent_mean <= hi')} AS sentiment_regime_neutral",
            "a",
        ),
    ],
    (100,),
    [],
    [f"sentiment_regime_{x}" for x in ("bullish", "bearish", "neutral")],
    fill=fill,
)


def _volatility(fill: str | None = None) -> str:
    return _sql(
    [
        ("a", f"{roll('stddev_samp', 'sent_mean', 24)} AS s", "base"),
        ("b", f"{flag('s > ' + roll_quantile('s', 0.75, 100))} AS high_sentiment_volatility", "a"),
    ],
    (24, 100),
    [],
    ["high_sentiment_volatility"],
    fill=fill,
)


_mv, _mv_real, _mv_whole = _moves()
_ac, _ac_real, _ac_whole = _accelerations()

ORACLES = {
    "j01_news_to_bar": f"WITH {_mapped_ctes(False)} SELECT article_id, CAST(bar_ts AS VARCHAR) AS bar_ts FROM mapped",
    "j01_news_to_bar_compat": f"WITH {_mapped_ctes(True)} SELECT article_id, CAST(bar_ts AS VARCHAR) AS bar_ts FROM mapped",
    "j02_next_session_open": f"""WITH {SESSION_BARS}, {ARTICLES}, {_SEARCH}
SELECT s.article_id, CAST(o.bar_ts AS VARCHAR) AS bar_ts
FROM searched s ASOF LEFT JOIN opens o ON s.symbol = o.symbol AND s.own_open <= o.bar_ts""",
    "j03_bars_with_news": f"WITH {_NEWS_BARS} "
    + final(
        "joined",
        ["bar_ts"],
        ["open", "high", "low", "close", "volume", "sent_mean", "sent_max_abs"],
        ["symbol", *_COUNTS],
    ),
    "j04_asof_backward": "WITH marks AS (SELECT user_id, ts AS bought_at, value AS bought FROM events "
    "WHERE event_type = 'purchase') SELECT e.event_id, epoch_us(m.bought_at) AS bought_at, "
    "CASE WHEN round(m.bought, 6) = 0 THEN CAST(0 AS DOUBLE) ELSE round(m.bought, 6) END AS bought "
    "FROM events e ASOF LEFT JOIN marks m ON e.user_id = m.user_id AND e.ts >= m.bought_at",
    "j04_asof_same_names": "WITH marks AS (SELECT user_id, ts AS ts_mark, value AS value_mark FROM events "
    "WHERE event_type = 'purchase') SELECT e.event_id, epoch_us(e.ts) AS ts, epoch_us(m.ts_mark) AS ts_mark, "
    + sql_real("e.value", "value") + ", " + sql_real("m.value_mark", "value_mark")
    + " FROM events e ASOF LEFT JOIN marks m ON e.user_id = m.user_id AND e.ts >= m.ts_mark",
    "j04_asof_forward": "WITH marks AS (SELECT user_id, ts AS bought_at FROM events "
    "WHERE event_type = 'purchase') SELECT e.event_id, epoch_us(m.bought_at) AS bought_at "
    "FROM events e ASOF LEFT JOIN marks m ON e.user_id = m.user_id AND e.ts <= m.bought_at",
    "j04_asof_one_second": """WITH timed AS (
  SELECT event_id, event_type, value, make_timestamp(1700000000000000 + event_id * 7919 % 1000000) AS moment FROM events),
points AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN 'x' END AS entity, CASE WHEN event_id % 13 <> 0 THEN moment END AS met FROM timed),
marks AS (
  SELECT entity, met, max(value) AS value FROM (
    SELECT CASE WHEN event_id % 5 <> 0 THEN 'x' END AS entity, CASE WHEN event_id % 7 <> 0 THEN moment END AS met, value
    FROM timed WHERE event_type = 'purchase')
  WHERE entity IS NOT NULL AND met IS NOT NULL GROUP BY 1, 2)
SELECT p.event_id, """
    + sql_real("m.value", "value")
    + " FROM points p ASOF LEFT JOIN marks m ON p.entity = m.entity AND p.met >= m.met",
    "j09_features_side_by_side": _sql(
        [
            (
                "a",
                f"({div('close', 'lag(close, 5) OVER e')} - 1) * 100 AS momentum_5, "
                f"{flag('hour(bar_ts) >= 9 AND hour(bar_ts) < 16')} AS market_open, "
                f"CAST({roll('sum', 'headline_count', 12)} AS BIGINT) AS news_intensity_12h, "
                f"{flag('sent_mean > 0.5')} AS extreme_positive_sentiment",
                "base",
            )
        ],
        (12,),
        ["momentum_5"],
        ["market_open", "news_intensity_12h", "extreme_positive_sentiment", "headline_count"],
    ),
    "g01_news_per_bar": f"WITH {_per_bar_cte()} "
    + final("per_bar", ["bar_ts"], ["sent_mean", "sent_max_abs"], ["symbol", *_COUNTS]),
    "g01_news_per_bar_compat": f"WITH {_per_bar_cte(True)} "
    + final("per_bar", ["bar_ts"], ["sent_mean", "sent_max_abs"], ["symbol", *_COUNTS]),
    "g02_folded_labels": f"WITH {ARTICLES} SELECT symbol, CASE WHEN label LIKE '%Bullish' THEN 'Bullish' "
    "WHEN label LIKE '%Bearish' THEN 'Bearish' ELSE label END AS label, count(*) AS articles "
    "FROM articles GROUP BY 1, 2",
    "a13_full_bar_table": f"""WITH {HOURLY_BARS},
i AS (SELECT *, 100 * {div('close - ' + roll('min', 'low', 14), roll('max', 'high', 14) + ' - ' + roll('min', 'low', 14))} AS rsi,
      {roll('avg', 'close', 12)} - {roll('avg', 'close', 26)} AS macd FROM bars {windows(sizes=(12, 14, 26))}),
r AS (SELECT * REPLACE (CASE WHEN hour(bar_ts) % 3 = 0 THEN close + 1 ELSE close END AS close) FROM i) """
    + final("r", ["bar_ts"], ["open", "high", "low", "close", "volume", "rsi", "macd"], ["symbol"]),
    "n01_rolling_statistics": _statistics(),
    "n01_rolling_statistics_filled": _statistics("ffill"),
    "n02_sentiment_moves": _sql([("a", _mv, "base")], (), _mv_real, _mv_whole),
    "n03_sentiment_accelerations": _sql([("a", _ac, "base")], (), _ac_real, _ac_whole),
    "n04_smoothed_momentum": _sql(
        [
            ("a", ", ".join(f"list({c}) OVER c AS h_{c}" for c in MOVING), "base"),
            (
                "b",
                ", ".join(
                    f"{_weighted(f'h_{c}', 3)} - {_weighted(f'h_{c}', 10)} AS {c}_ema_momentum" for c in MOVING
                ),
                "a",
            ),
        ],
        (),
        [f"{c}_ema_momentum" for c in MOVING],
    ),
    "n05_trend_strength": _sql(
        [
            ("a", "row_number() OVER e AS i", "base"),
            (
                "b",
                ", ".join(
                    f"CASE WHEN count({c}) OVER w10 = 10 AND max({c}) OVER w10 > min({c}) OVER w10 "
                    f"THEN corr({c}, i) OVER w10 END AS {c}_trend_strength"
                    for c in MOVING
                ),
                "a",
            ),
        ],
        (10,),
        [f"{c}_trend_strength" for c in MOVING],
    ),
    "n06_news_intensity": _sql(
        [
            (
                "a",
                ", ".join(
                    f"CAST({roll('sum', 'headline_count', n)} AS BIGINT) AS news_intensity_{n}h"
                    for n in (6, 12, 24, 48)
                ),
                "base",
            )
        ],
        (6, 12, 24, 48),
        [],
        [f"news_intensity_{n}h" for n in (6, 12, 24, 48)],
    ),
    "n07_news_frequency": _sql(
        [
            (
                "a",
                f"{roll('avg', 'headline_count', 12)} AS news_frequency_hourly, "
                f"{roll('avg', 'headline_count', 288)} AS news_frequency_daily",
                "base",
            )
        ],
        (12, 288),
        ["news_frequency_hourly", "news_frequency_daily"],
    ),
    "n08_news_burst": _sql(
        [
            (
                "a",
                flag(
                    f"headline_count > {roll('avg', 'headline_count', 24)} + 2 * "
                    f"{roll('stddev_samp', 'headline_count', 24)}"
                )
                + " AS news_burst",
                "base",
            )
        ],
        (24,),
        [],
        ["news_burst"],
    ),
    "n09_news_drought": _sql(
        [
            ("a", f"{flag('headline_count = 0')} AS z", "base"),
            ("b", f"CAST({roll('sum', 'z', 12)} AS BIGINT) AS news_drought", "a"),
        ],
        (12,),
        [],
        ["news_drought"],
    ),
    "n10_time_since_news": _sql(
        [
            ("a", "count(CASE WHEN headline_count > 0 THEN 1 END) OVER c AS g", "base"),
            ("b", "row_number() OVER (PARTITION BY symbol, g ORDER BY bar_ts) - 1 AS time_since_news", "a"),
        ],
        (),
        [],
        ["time_since_news"],
    ),
    "n11_sentiment_regimes": _regimes("zero"),
    "n12_sentiment_volatility": _volatility("ffill"),
    "n13_extreme_sentiment": _sql(
        [
            (
                "a",
                f"{flag('sent_mean > 0.5')} AS extreme_positive_sentiment, "
                f"{flag('sent_mean < -0.5')} AS extreme_negative_sentiment",
                "base",
            )
        ],
        (),
        [],
        ["extreme_positive_sentiment", "extreme_negative_sentiment"],
    ),
    "n14_sentiment_persistence": _sql(
        [
            ("a", f"{flag('sent_mean > 0')} AS p, {flag('sent_mean < 0')} AS q", "base"),
            (
                "b",
                ", ".join(
                    f"{roll('sum', x, n)} / {n}.0 AS {name}_persistence_{n}h"
                    for n in (6, 12, 24)
                    for x, name in (("p", "bullish"), ("q", "bearish"))
                ),
                "a",
            ),
        ],
        (6, 12, 24),
        [f"{name}_persistence_{n}h" for n in (6, 12, 24) for name in ("bullish", "bearish")],
    ),
}
ORACLES["j01_news_to_bar_off_grid"] = ORACLES["j01_news_to_bar"]
ORACLES["g01_news_per_bar_off_grid"] = ORACLES["g01_news_per_bar"]


def _everything() -> str:
    """All groups side by side on the bar, sentiment left missing."""
    parts = [ORACLES[n] for n in sorted(ORACLES) if n[0] == "n" and n[1:3] not in ("01", "11", "12")]
    parts += [_statistics(), _regimes(), _volatility()]
    joins = " ".join(f"JOIN ({sql}) USING (symbol, bar_ts)" for sql in parts[1:])
    return f"SELECT * FROM ({parts[0]}) {joins}"


ORACLES["sentiment_all"] = _everything()
