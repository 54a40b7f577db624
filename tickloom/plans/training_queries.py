"""The usual training plan and its report, and SQL that selects features on its own.

The SQL takes the unrounded feature statements of the other query modules,
turns them into (feature, row) cells, and derives roles, bins, scores, the
selection, scaling and filling from those.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tickloom.plans import market_queries, news_queries, shapes, technical_queries
from tickloom.plans.present import present, sql_real
from tickloom.plans.sql_parts import HOURLY_BARS, SESSION_BARS, single
from tickloom.plans.training_table import TrainingPlan, TrainingTable, build_training_table

KEYS = ["symbol", "bar_ts"]


def _long(made: TrainingTable):
    """(symbol, bar_ts, feature, value) of all selected features."""
    names = list(dict.fromkeys(c for cs in made.selected.values() for c in cs))
    wide = made.table.select(*KEYS, *[F.col(c).cast("double").alias(c) for c in names])
    return present(wide.unpivot(KEYS, names, "feature", "value"))


def _default_plan(spark, folder) -> TrainingTable:
    """All features of session bars with news, with the plan's own limits, lags and products."""
    symbols = spark.createDataFrame([("S0", "Industry"), ("S1", "Energy")], "symbol string, sector string")
    series = shapes.session_series(spark, folder)
    return build_training_table(news_queries.news_bars(spark, folder), series, info=symbols)


def _small_plan(spark, folder) -> TrainingTable:
    series = shapes.hourly_series(spark, folder)
    plan = TrainingPlan(
        technical_groups=["momentum", "candles"],
        include_events=False,
        lag_periods=(1, 5),
        interactions=[("open", "volume"), ("close", "volume")],
        max_features={"unknown_future": 12, "known_future": 4, "static": 4},
    )
    return build_training_table(shapes.hourly_bars(spark, folder), series, plan)


def _report(spark, folder):
    return present(_small_plan(spark, folder).report().drop("elapsed_seconds"))


QUERIES = {
    "p14_default_plan": lambda s, d: _long(_default_plan(s, d)),
    "g11_training_report": _report,
}


# --- SQL --------------------------------------------------------------------

_ROUNDED = re.compile(r"CASE WHEN round\((\w+) \+ 1e-\d+, \d+\) = 0 THEN CAST\(0 AS DOUBLE\) ELSE round\(\1 \+ 1e-\d+, \d+\) END AS \1")

#: names that decide a role, as in the specification
_STATIC = "sector|market_cap|beta|industry|exchange|currency|country"
_KNOWN = (
    "fed_meeting|earnings|holiday|expiration|employment_report|cpi_release|gdp_release|jobless_claims|market_holiday|"
    "half_day_trading|options_expiration|days_to_|days_since_|hour_sin|hour_cos|dow_sin|dow_cos|dom_sin|dom_cos|"
    "month_sin|month_cos|market_open|pre_market|after_hours"
)
_UNLAGGED = "_lag_|regime|_sin|_cos|category"


def _raw(sql: str) -> str:
    """A statement without the rounding of its last step."""
    return _ROUNDED.sub(r"\1", sql)


def _technical(groups: list[str], bars: str) -> str:
    """Feature groups side by side on the bars; bar_ts as text."""
    parts = [_raw(technical_queries.ORACLES[g]).replace(HOURLY_BARS, bars) for g in groups]
    base = f"(WITH {bars} SELECT symbol, CAST(bar_ts AS VARCHAR) AS bar_ts, open, high, low, close, volume FROM bars)"
    return f"{base} " + " ".join(f"JOIN ({p}) USING (symbol, bar_ts)" for p in parts)


def _selected(source: str, limits: dict[str, int], periods: tuple[int, ...], pairs: list[tuple[str, str]]) -> str:
    """CTEs up to `chosen` (feature, role, score) and `filled` (symbol, bar_ts, feature, value)
    for a source (symbol, bar_ts text, numbers) that is CTE `base`."""
    keys = "symbol, bar_ts, time_idx, is_train, target"
    cells = f"COLUMNS(* EXCLUDE ({keys}))"
    qs = ", ".join(str(i / 10) for i in range(1, 10))
    aim = single("target")
    lags = " ".join(
        f"UNION ALL SELECT {keys}, feature || '_lag_{k}', feature, 'unknown_future', "
        f"lag(value, {k}) OVER (PARTITION BY symbol, feature ORDER BY time_idx) FROM lagged"
        for k in periods
    )
    products = " ".join(
        f"UNION ALL SELECT {keys}, '{a}_x_{b}', '{a}_x_{b}', 'unknown_future', {a} * {b} FROM aimed "
        f"WHERE (SELECT count(*) FROM roles WHERE role = 'unknown_future' AND feature IN ('{a}', '{b}')) = 2 - CAST('close' IN ('{a}', '{b}') AS INTEGER)"
        for a, b in pairs
    )
    limit = "CASE role " + " ".join(f"WHEN '{r}' THEN {n}" for r, n in limits.items()) + " END"
    return f"""{source},
ahead AS (SELECT *, lead(close, 12) OVER (PARTITION BY symbol ORDER BY bar_ts) AS target FROM base),
numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) - 1 AS time_idx,
                    count(*) OVER (PARTITION BY symbol) AS n_rows FROM ahead WHERE target IS NOT NULL),
aimed AS (SELECT * EXCLUDE (n_rows), time_idx < floor(0.8 * n_rows) AS is_train FROM numbered),
numbers AS (SELECT {keys}, CAST({cells} AS DOUBLE) FROM aimed),
cells AS (SELECT * FROM numbers UNPIVOT INCLUDE NULLS (value FOR feature IN ({cells}))),
ratios AS (SELECT feature, count(DISTINCT value) / count(*) AS ratio FROM cells WHERE is_train AND feature <> 'close' GROUP BY 1),
roles AS (SELECT feature, CASE WHEN regexp_matches(feature, '{_STATIC}') THEN 'static'
                               WHEN regexp_matches(feature, '{_KNOWN}') THEN 'known_future'
                               WHEN ratio < 0.01 THEN 'static' ELSE 'unknown_future' END AS role FROM ratios),
lagged AS (SELECT * FROM cells WHERE (feature IN (SELECT feature FROM roles WHERE role = 'unknown_future')
                                      AND NOT regexp_matches(feature, '{_UNLAGGED}')) OR feature = 'close'),
candidates({keys}, feature, base, role, value) AS (
  SELECT {keys}, feature, feature, role, value FROM cells JOIN roles USING (feature) {products} {lags}),
singles AS (SELECT symbol, time_idx, feature, base, role, target, value IS NOT NULL AS present, coalesce({single('value')}, 0) AS v
            FROM candidates WHERE is_train),
cuts AS (SELECT feature AS base, list_distinct(quantile_cont(coalesce({single('value')}, 0), [{qs}])) AS cut FROM (
           SELECT feature, value FROM candidates WHERE is_train AND feature = base
           UNION ALL SELECT feature, value FROM cells WHERE is_train AND feature = 'close') GROUP BY 1),
aims AS (SELECT list_distinct(quantile_cont({aim}, [{qs}])) AS aim FROM aimed WHERE is_train),
binned AS (SELECT feature, role, present, len(list_filter(cut, lambda c: v > c)) AS bx,
                  len(list_filter(aim, lambda c: {aim} > c)) AS byy
           FROM singles JOIN cuts USING (base), aims),
pairs AS (SELECT feature, role, bx, byy, count(*) AS n, count(*) FILTER (present) AS held FROM binned GROUP BY ALL),
shares AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bx) AS nx,
                  sum(n) OVER (PARTITION BY feature, byy) AS ny FROM pairs),
scores AS (SELECT feature, role, sum(held) / sum(n) AS present_share, round(sum(n / t * ln(n * t / (nx * ny))), 9) AS score
           FROM shares GROUP BY 1, 2),
chosen AS (SELECT feature, role, score FROM scores WHERE present_share > 0.1
           QUALIFY row_number() OVER (PARTITION BY role ORDER BY score DESC, feature) <= {limit}),
values_of AS (SELECT c.* FROM candidates c JOIN chosen USING (feature)),
parts AS (SELECT feature, quantile_cont(value, 0.5) AS middle,
                 quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS width
          FROM values_of WHERE is_train GROUP BY 1),
scaled AS (SELECT v.* EXCLUDE (value), middle, CASE WHEN role = 'static' THEN value
             ELSE (value - middle) / CASE WHEN width = 0 THEN 1 ELSE width END END AS value FROM values_of v JOIN parts USING (feature)),
filled AS (SELECT symbol, bar_ts, feature, role, coalesce(
             last_value(value IGNORE NULLS) OVER (PARTITION BY symbol, feature ORDER BY time_idx ROWS UNBOUNDED PRECEDING),
             CASE WHEN role = 'static' THEN middle END, 0) AS value FROM scaled)"""


_GROUPS = sorted(
    n for n in technical_queries.ORACLES if n not in ("t02_band_squeeze", "t03_band_breakouts", "t11_rsi_states", "t12_macd_crosses", "technical_all")
)
_CALENDAR = market_queries.ORACLES["calendar_all"].replace(
    "min(o_orderdate)", "min(ts)"
).replace("max(o_orderdate)", "max(ts)").replace(
    "FROM orders", "FROM events WHERE event_type <> 'error' AND isodow(ts) <= 5 AND hour(ts) BETWEEN 4 AND 19"
)
_DEFAULT_BASE = f"""
base AS (
  SELECT * EXCLUDE (day, sector), dense_rank() OVER (ORDER BY sector) - 1 AS sector,
         0 AS industry, 0 AS market_cap_category, 0 AS exchange, 0 AS beta_category, 0 AS country, 0 AS dividend_paying, 0 AS sp500_member
  FROM (SELECT *, CAST(CAST(bar_ts AS DATE) AS VARCHAR) AS day,
               CASE symbol WHEN 'S0' THEN 'Industry' WHEN 'S1' THEN 'Energy' ELSE 'Unknown' END AS sector
        FROM {_technical(_GROUPS, SESSION_BARS)}
        JOIN ({_raw(news_queries.ORACLES['j03_bars_with_news'])}) n USING (symbol, bar_ts, open, high, low, close, volume)
        JOIN ({_raw(news_queries.ORACLES['sentiment_all'])}) USING (symbol, bar_ts)) b
  LEFT JOIN ({_CALENDAR}) USING (day))"""
_DEFAULT_PAIRS = [
    *[(p, v) for p in ("open", "high", "low") for v in ("volume", "volume_ratio_5")],
    *[(s, v) for s in ("sent_mean", "sent_max_abs", "sent_mean_ma_3") for v in ("volatility_5", "volatility_10")],
]
_DEFAULT = _selected(_DEFAULT_BASE, {"unknown_future": 40, "known_future": 15, "static": 8}, (1, 3, 5, 10, 20), _DEFAULT_PAIRS)
_SMALL = _selected(
    f"base AS (SELECT * FROM {_technical(['t13_momentum', 't16_candle_ratios'], HOURLY_BARS)})",
    {"unknown_future": 12, "known_future": 4, "static": 4},
    (1, 5),
    [("open", "volume"), ("close", "volume")],
)

ORACLES = {
    "p14_default_plan": f"WITH {_DEFAULT} SELECT symbol, bar_ts, feature, {sql_real('value', 'value')} FROM filled",
    "g11_training_report": f"""WITH {_SMALL},
counts AS (SELECT count(*) FILTER (role = 'unknown_future') AS u, count(*) FILTER (role = 'known_future') AS k,
                  count(*) FILTER (role = 'static') AS s, count(*) AS n FROM chosen),
gaps AS (SELECT count(*) FILTER (value IS NULL) AS missing FROM filled),
best AS (SELECT list(feature ORDER BY score DESC, feature) AS names FROM (
           SELECT * FROM chosen ORDER BY score DESC, feature LIMIT 10))
SELECT count(*) AS rows, min(bar_ts) AS first_ts, max(bar_ts) AS last_ts,
       {sql_real('100.0 * any_value(missing) / (count(*) * (6 + any_value(n)))', 'missing_percentage')},
       CAST(6 + any_value(n) AS INTEGER) AS columns, CAST(any_value(u) AS INTEGER) AS unknown_future_features,
       CAST(any_value(k) AS INTEGER) AS known_future_features, CAST(any_value(s) AS INTEGER) AS static_features,
       any_value(names) AS top_features
FROM aimed, counts, gaps, best""",
}
