"""Queries and SQL for the calendar and the daily market context."""

from __future__ import annotations


from tickloom.operators import calendar as C
from tickloom.operators import cross_asset as X
from tickloom.plans import shapes
from tickloom.plans.present import present
from tickloom.plans.sql_parts import DAILY, ORDER_BARS, div, final, flag, roll, windows
from tickloom.session import materialise


def _calendar(*columns):
    def query(spark, folder):
        orders = shapes.table(spark, folder, "orders")
        days = C.economic_calendar(spark, *C.day_span(orders, "o_orderdate"))
        return present(days.select("day", *(columns or C.CALENDAR_COLUMNS)))

    return query


def _joined(nearest):
    def query(spark, folder):
        events = shapes.table(spark, folder, "events").select("event_id", "ts")
        df = C.with_calendar(events, "ts", nearest=nearest)
        return present(df.select("event_id", "jobless_claims", "cpi_release", "days_to_fed_meeting"))

    return query


def _daily(make, *columns, drop=()):
    def query(spark, folder):
        df = make(shapes.daily_closes(spark, folder))
        return present(df.select("day", *columns) if columns else df.drop(*drop))

    return query


def _spread(spark, folder):
    df = X.curve_features(shapes.daily_closes(spark, folder))
    return present(df.select("day", "yield_spread"))


def _on_bars(spark, folder):
    bars = shapes.order_bars(spark, folder).select("symbol", "bar_ts", "close")
    # a landed table as a rule; here it is made from the lines once
    daily = materialise(shapes.daily_closes(spark, folder), "daily")
    df = X.cross_asset_features(bars, daily, shapes.SECTORS)
    return present(df)


def _sectors(daily):
    return X.sector_features(daily, shapes.SECTORS)


_ACROSS = ("sector_dispersion", "sector_range", "sector_momentum_dispersion")

QUERIES = {
    "c01_day_table": _calendar("fed_meeting", "market_holiday"),
    "c02_fed_meeting": _calendar("fed_meeting"),
    "c03_days_to_meeting": _calendar("days_to_fed_meeting", "days_since_fed_meeting"),
    "c04_earnings_season": _calendar("earnings_season"),
    "c05_employment_report": _calendar("employment_report"),
    "c06_data_releases": _calendar("cpi_release", "gdp_release", "jobless_claims"),
    "c07_market_holiday": _calendar("market_holiday"),
    "c08_half_day_trading": _calendar("half_day_trading"),
    "c09_options_expiration": _calendar("options_expiration"),
    "calendar_all": _calendar(),
    "j05_calendar_by_day": _joined(False),
    "j06_calendar_nearest": _joined(True),
    "x01_volatility_index": _daily(X.volatility_features),
    "x02_yields": _daily(X.yield_features),
    "x03_yield_curve": _daily(X.curve_features),
    "j07_common_yield_days": _spread,
    "j08_treasury_outer_join": _daily(X.treasury_features),
    "x04_dollar_index": _daily(X.dollar_features),
    "x05_sector_moves": _daily(_sectors, drop=_ACROSS),
    "x06_sector_dispersion": _daily(_sectors, *_ACROSS),
    "x07_daily_context_on_bars": _on_bars,
}

_DAYS = """
span AS (SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders),
days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL '1 day')) AS DATE) AS day, lo, hi FROM span)"""

# first days of months around the range, and the meeting of each listed one
_MEETINGS = """
months AS (
  SELECT CAST(unnest(generate_series(date_trunc('month', lo) - INTERVAL '3 months',
         hi + INTERVAL '3 months', INTERVAL '1 month')) AS DATE) AS m, lo, hi FROM span),
meetings AS (
  SELECT m + CAST((2 - (isodow(m) - 1) + 7) % 7 AS INTEGER) + 6 AS met FROM months
  WHERE month(m) IN (1, 3, 5, 6, 7, 9, 11, 12)
    AND m + CAST((2 - (isodow(m) - 1) + 7) % 7 AS INTEGER) + 6 BETWEEN lo AND hi)"""

_RULES = {
    "earnings_season": "(month(day) IN (1, 4, 7, 10) AND day(day) >= 15) OR "
    "(month(day) = 2 AND day(day) <= 4) OR (month(day) = 5 AND day(day) <= 5) OR "
    "(month(day) = 8 AND day(day) <= 4) OR (month(day) = 11 AND day(day) <= 4)",
    "employment_report": "isodow(day) = 5 AND day(day) <= 7",
    "cpi_release": "day(day) BETWEEN 10 AND 15",
    "gdp_release": "day(day) BETWEEN 25 AND 31",
    "jobless_claims": "isodow(day) = 4",
    "market_holiday": "(month(day) = 1 AND day(day) = 1) OR (month(day) = 7 AND day(day) = 4) OR "
    "(month(day) = 12 AND day(day) = 25) OR "
    "(month(day) = 11 AND isodow(day) = 4 AND day(day) BETWEEN 22 AND 28)",
    "half_day_trading": "(month(day) = 11 AND isodow(day) = 5 AND day(day) BETWEEN 23 AND 29) OR "
    "(month(day) = 12 AND day(day) = 24)",
    "options_expiration": "isodow(day) = 5 AND day(day) BETWEEN 15 AND 21",
}
_RULE_COLUMNS = ", ".join(f"{flag(rule)} AS {name}" for name, rule in _RULES.items())
_CALENDAR = f"""{_DAYS}, {_MEETINGS},
calendar AS (
  SELECT d.day, {_RULE_COLUMNS},
         CAST((SELECT count(*) FROM meetings WHERE met = d.day) > 0 AS INTEGER) AS fed_meeting,
         CAST(n.met - d.day AS DOUBLE) AS days_to_fed_meeting,
         CAST(d.day - p.met AS DOUBLE) AS days_since_fed_meeting
  FROM days d ASOF LEFT JOIN meetings n ON d.day <= n.met ASOF LEFT JOIN meetings p ON d.day >= p.met)"""


def _calendar_sql(*columns: str) -> str:
    picked = ", ".join(columns or C.CALENDAR_COLUMNS)
    return f"WITH {_CALENDAR} SELECT CAST(day AS VARCHAR) AS day, {picked} FROM calendar"


def _joined_sql(day: str) -> str:
    ctes = _CALENDAR.replace("o_orderdate", "ts").replace("FROM orders", "FROM events")
    return f"""WITH {ctes}, e AS (SELECT event_id, {day} AS day FROM events, span)
SELECT event_id, jobless_claims, cpi_release, days_to_fed_meeting
FROM e LEFT JOIN calendar USING (day)"""


def _change(k: int, x: str = "close") -> str:
    return f"({div(x, f'lag({x}, {k}) OVER e')} - 1)"


def _series_sql(steps, sizes, reals, whole=(), part="series") -> str:
    ctes = [DAILY]
    for name, columns, source in steps:
        ctes.append(f"{name} AS (SELECT *, {columns} FROM {source} {windows(part, 'day', sizes)})")
    return f"WITH {', '.join(ctes)} " + final(steps[-1][0], ["day"], reals, whole)


def _gap(n: int) -> str:
    return f"({div('close', roll('avg', 'close', n))} - 1) * 100"


_VIX_REAL = [
    "vix", "vix_change", "vix_ma_5", "vix_ma_20", "vix_to_ma5", "vix_to_ma20",
    "vix_volatility", "vix_momentum", "vix_acceleration",
]
_VIX = [
    ("v", "close AS vix, close - lag(close, 5) OVER e AS vix_momentum", "(SELECT * FROM daily WHERE series = 'VIX')"),
    (
        "vix_rows",
        f"{_change(1)} * 100 AS vix_change, {roll('avg', 'close', 5)} AS vix_ma_5, "
        f"{roll('avg', 'close', 20)} AS vix_ma_20, {_gap(5)} AS vix_to_ma5, {_gap(20)} AS vix_to_ma20, "
        f"{roll('stddev_samp', 'close', 10)} AS vix_volatility, {flag('close < 20')} AS vix_low_regime, "
        f"{flag('close > 30')} AS vix_high_regime, "
        f"{flag(f'CASE WHEN lag(close) OVER e = 0 THEN close > 0 ELSE {_change(1)} > 0.1 END')} AS vix_spike, "
        "vix_momentum - lag(vix_momentum, 3) OVER e AS vix_acceleration",
        "v",
    ),
]
_VIX_WHOLE = ["vix_low_regime", "vix_high_regime", "vix_spike"]

_DXY_REAL = [
    "dxy", "dxy_change", "dxy_ma_5", "dxy_ma_20", "dxy_ma_50", "dxy_to_ma5", "dxy_to_ma20",
    "dxy_momentum", "dxy_volatility",
]
_DXY = [
    (
        "dxy_rows",
        f"close AS dxy, {_change(1)} * 100 AS dxy_change, "
        + ", ".join(f"{roll('avg', 'close', n)} AS dxy_ma_{n}" for n in (5, 20, 50))
        + f", {_gap(5)} AS dxy_to_ma5, {_gap(20)} AS dxy_to_ma20, "
        f"{flag('close > ' + roll('avg', 'close', 20))} AS dxy_strong, "
        "close - lag(close, 5) OVER e AS dxy_momentum, "
        f"{roll('stddev_samp', 'close', 10)} AS dxy_volatility",
        "(SELECT * FROM daily WHERE series = 'DXY')",
    )
]


def _tenor(series: str, label: str) -> str:
    return (
        f"(SELECT day, close AS yield_{label}, close - lag(close) OVER e AS yield_{label}_change, "
        f"{roll('avg', 'close', 5)} AS yield_{label}_ma_5, {roll('avg', 'close', 20)} AS yield_{label}_ma_20 "
        f"FROM daily WHERE series = '{series}' {windows('series', 'day', (5, 20))})"
    )


_YIELD_REAL = [f"yield_{t}{s}" for t in ("2y", "10y") for s in ("", "_change", "_ma_5", "_ma_20")]
_YIELDS = f"yield_rows AS (SELECT * FROM {_tenor('FVX', '2y')} FULL JOIN {_tenor('TNX', '10y')} USING (day))"
_CURVE = f"""
spreads AS (
  SELECT a.day, b.close - a.close AS yield_spread, b.close / nullif(a.close + 0.01, 0) AS yield_ratio
  FROM daily a JOIN daily b ON a.day = b.day AND a.series = 'FVX' AND b.series = 'TNX'),
moved AS (SELECT *, yield_spread - lag(yield_spread) OVER (ORDER BY day) AS yield_spread_change FROM spreads),
curve_rows AS (
  SELECT *, {roll('avg', 'yield_spread', 5)} AS yield_spread_ma_5,
         {flag('yield_spread_change > 0')} AS curve_steepening,
         {flag('yield_spread_change < 0')} AS curve_flattening,
         {flag('yield_spread < 0')} AS inverted_curve
  FROM moved WINDOW w5 AS (ORDER BY day ROWS 4 PRECEDING))"""
_CURVE_REAL = ["yield_spread", "yield_spread_change", "yield_spread_ma_5", "yield_ratio"]
_CURVE_WHOLE = ["curve_steepening", "curve_flattening", "inverted_curve"]

_PARTS = ("return", "ma_5", "ma_20", "to_ma20", "momentum_5", "momentum_20")
_SECTORS = f"""
moves AS (
  SELECT series, day, {_change(1)} * 100 AS "return", {roll('avg', 'close', 5)} AS ma_5,
         {roll('avg', 'close', 20)} AS ma_20, {_gap(20)} AS to_ma20,
         {_change(5)} * 100 AS momentum_5, {_change(20)} * 100 AS momentum_20
  FROM daily WHERE series LIKE 'XL%' {windows('series', 'day', (5, 20))}),
sector_rows AS (
  SELECT day, """ + ", ".join(
    f"max(\"{p}\") FILTER (series = '{s}') AS {s}_{p}" for s in shapes.SECTORS for p in _PARTS
) + """,
         stddev_samp("return") AS sector_dispersion, max("return") - min("return") AS sector_range,
         stddev_samp(momentum_5) AS sector_momentum_dispersion
  FROM moves GROUP BY day)"""
_SECTOR_REAL = [f"{s}_{p}" for s in shapes.SECTORS for p in _PARTS]


def _all_daily_ctes() -> str:
    ctes = [DAILY]
    for steps, sizes in ((_VIX, (5, 10, 20)), (_DXY, (5, 10, 20, 50))):
        for name, columns, source in steps:
            ctes.append(f"{name} AS (SELECT *, {columns} FROM {source} {windows('series', 'day', sizes)})")
    ctes += [
        _YIELDS,
        _CURVE,
        "treasury_rows AS (SELECT * FROM yield_rows FULL JOIN curve_rows USING (day))",
        _SECTORS,
    ]
    return ", ".join(ctes)


_CONTEXT_REAL = [*_VIX_REAL, *_YIELD_REAL, *_CURVE_REAL, *_DXY_REAL, *_SECTOR_REAL, *_ACROSS]
_CONTEXT_WHOLE = [*_VIX_WHOLE, *_CURVE_WHOLE, "dxy_strong"]
_TREASURY = f"WITH {DAILY}, {_YIELDS}, {_CURVE}, treasury_rows AS (SELECT * FROM yield_rows FULL JOIN curve_rows USING (day)) "

ORACLES = {
    "c01_day_table": _calendar_sql("fed_meeting", "market_holiday"),
    "c02_fed_meeting": _calendar_sql("fed_meeting"),
    "c03_days_to_meeting": _calendar_sql("days_to_fed_meeting", "days_since_fed_meeting"),
    "c04_earnings_season": _calendar_sql("earnings_season"),
    "c05_employment_report": _calendar_sql("employment_report"),
    "c06_data_releases": _calendar_sql("cpi_release", "gdp_release", "jobless_claims"),
    "c07_market_holiday": _calendar_sql("market_holiday"),
    "c08_half_day_trading": _calendar_sql("half_day_trading"),
    "c09_options_expiration": _calendar_sql("options_expiration"),
    "calendar_all": _calendar_sql(),
    "j05_calendar_by_day": _joined_sql("CAST(ts AS DATE)"),
    "j06_calendar_nearest": _joined_sql("least(CAST(ts + INTERVAL '12 hours' AS DATE), hi)"),
    "x01_volatility_index": _series_sql(_VIX, (5, 10, 20), _VIX_REAL, _VIX_WHOLE),
    "x02_yields": f"WITH {DAILY}, {_YIELDS} " + final("yield_rows", ["day"], _YIELD_REAL),
    "x03_yield_curve": f"WITH {DAILY}, {_CURVE} "
    + final("curve_rows", ["day"], _CURVE_REAL, _CURVE_WHOLE),
    "j07_common_yield_days": f"WITH {DAILY}, {_CURVE} " + final("curve_rows", ["day"], ["yield_spread"]),
    "j08_treasury_outer_join": _TREASURY
    + final("treasury_rows", ["day"], [*_YIELD_REAL, *_CURVE_REAL], _CURVE_WHOLE),
    "x04_dollar_index": _series_sql(_DXY, (5, 10, 20, 50), _DXY_REAL, ["dxy_strong"]),
    "x05_sector_moves": f"WITH {DAILY}, {_SECTORS} " + final("sector_rows", ["day"], _SECTOR_REAL),
    "x06_sector_dispersion": f"WITH {DAILY}, {_SECTORS} " + final("sector_rows", ["day"], _ACROSS),
    "x07_daily_context_on_bars": f"""WITH {ORDER_BARS}, {_all_daily_ctes()},
context AS (
  SELECT b.symbol, b.bar_ts, b.close AS bar_close, v.*, t.*, x.*, s.*
  FROM (SELECT *, CAST(bar_ts AS DATE) - 1 AS known FROM bars) b
  ASOF LEFT JOIN vix_rows v ON b.known >= v.day ASOF LEFT JOIN treasury_rows t ON b.known >= t.day
  ASOF LEFT JOIN dxy_rows x ON b.known >= x.day ASOF LEFT JOIN sector_rows s ON b.known >= s.day) """
    + final("context", ["bar_ts"], _CONTEXT_REAL, ["symbol", *_CONTEXT_WHOLE]).replace(
        "SELECT ", "SELECT CASE WHEN round(bar_close + 1e-10, 6) = 0 THEN 0 ELSE round(bar_close + 1e-10, 6) END AS close, ", 1
    ),
}
