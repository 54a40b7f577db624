"""Queries and SQL for the bar features, on hourly bars of five symbols."""

from __future__ import annotations

from collections.abc import Sequence

from tickloom.operators.technical import technical_features
from tickloom.plans import shapes
from tickloom.plans.present import present
from tickloom.plans.sql_parts import (
    HOURLY_BARS,
    div,
    final,
    flag,
    roll,
    roll_quantile,
    windows,
)

KEYS = ["symbol", "bar_ts"]
COARSE = {"vpt": 3, "vpt_ma_10": 3, "ad_line": 4, "ad_line_ma_10": 4}


def _features(*groups: str):
    def query(spark, folder):
        bars = shapes.hourly_bars(spark, folder)
        series = shapes.hourly_series(spark, folder)
        return present(technical_features(bars, series, groups=groups, keep=KEYS), coarse=COARSE)

    return query


def _with_indicators(**inputs):
    def query(spark, folder):
        bars = shapes.indicator_bars(spark, folder)
        series = shapes.hourly_series(spark, folder)
        return present(technical_features(bars, series, groups=(), keep=KEYS, **inputs))

    return query


def _every_feature(spark, folder):
    bars = shapes.indicator_bars(spark, folder)
    df = technical_features(
        bars,
        shapes.hourly_series(spark, folder),
        rsi_col="rsi",
        macd_cols=("macd", "macd_signal"),
    )
    return present(df, coarse=COARSE)


QUERIES = {
    "t01_band_position": _features("bands"),
    "t04_on_balance_volume": _features("on_balance_volume"),
    "t05_volume_price_trend": _features("volume_price_trend"),
    "t06_accumulation_line": _features("accumulation"),
    "t07_money_flow_ratio": _features("money_flow_ratio"),
    "t08_volume_weighted_means": _features("volume_weighted_means"),
    "t09_volume_ratios": _features("volume_ratios"),
    "t10_money_flow_index": _features("money_flow_index"),
    "t11_rsi_states": _with_indicators(rsi_col="rsi"),
    "t12_macd_crosses": _with_indicators(macd_cols=("macd", "macd_signal")),
    "t13_momentum": _features("momentum"),
    "t14_channel_index": _features("channel_index"),
    "t15_rates_of_change": _features("rates_of_change"),
    "t16_candle_ratios": _features("candles"),
    "t17_gaps_and_inside_bars": _features("bar_relations"),
    "t18_doji_hammer": _features("candle_shapes"),
    "t19_volatility": _features("volatility"),
    "t20_true_range": _features("true_ranges"),
    "t21_pivot_levels": _features("pivots"),
    "t22_local_extrema": _features("local_extrema"),
    "t23_clock_cycles": _features("clock"),
    "t24_sessions": _features("sessions"),
    "technical_all": _every_feature,
}


def _chain(steps: Sequence[tuple[str, str, str]], sizes: Sequence[int], reals, whole=()) -> str:
    """CTEs of (name, columns, source), each over the windows of `sizes`."""
    ctes = [HOURLY_BARS]
    for name, columns, source in steps:
        ctes.append(f"{name} AS (SELECT *, {columns} FROM {source} {windows(sizes=sizes)})")
    body = final(steps[-1][0], KEYS[1:], reals, ["symbol", *whole], coarse=COARSE)
    return f"WITH {', '.join(ctes)} {body}"


def _bands_sql() -> str:
    first = ", ".join(
        f"{roll('avg', 'close', p)} AS m{p}, {roll('stddev_samp', 'close', p)} AS d{p}"
        for p in (20, 50)
    )
    second = ", ".join(
        f"{div(f'close - (m{p} - 2*d{p})', f'(m{p} + 2*d{p}) - (m{p} - 2*d{p})')} AS bb_{p}_position, "
        f"{div(f'(m{p} + 2*d{p}) - (m{p} - 2*d{p})', f'm{p}')} AS bb_{p}_width, "
        f"{div(f'm{p} + 2*d{p} - close', 'close')} AS bb_{p}_upper_dist, "
        f"{div(f'close - (m{p} - 2*d{p})', 'close')} AS bb_{p}_lower_dist, "
        f"{flag(f'close > m{p} + 2*d{p}')} AS bb_{p}_breakout_up, "
        f"{flag(f'close < m{p} - 2*d{p}')} AS bb_{p}_breakout_down"
        for p in (20, 50)
    )
    third = ", ".join(
        f"{flag(f'bb_{p}_width < ' + roll_quantile(f'bb_{p}_width', 0.2, 20))} AS bb_{p}_squeeze"
        for p in (20, 50)
    )
    parts = ("position", "width", "upper_dist", "lower_dist")
    marks = ("squeeze", "breakout_up", "breakout_down")
    return _chain(
        [("a", first, "bars"), ("b", second, "a"), ("d", third, "b")],
        (20, 50),
        [f"bb_{p}_{x}" for p in (20, 50) for x in parts],
        [f"bb_{p}_{x}" for p in (20, 50) for x in marks],
    )


FLOW = "((close - low) - (high - close)) / (high - low + 1e-10) * volume"
TYPICAL = "(high + low + close) / 3"


def _change(x: str, k: int) -> str:
    return f"({div(x, f'lag({x}, {k}) OVER e')} - 1)"


def _weighted(x: str, span: int) -> str:
    d = 1 - 2 / (span + 1)
    low = f"list_sum(list_transform(h_{x}, lambda v, i: CASE WHEN v IS NULL THEN 0 ELSE pow({d!r}, len(h_{x}) - i) END))"
    top = f"list_sum(list_transform(h_{x}, lambda v, i: v * pow({d!r}, len(h_{x}) - i)))"
    return f"{top} / nullif({low}, 0)"


ROC = (1, 3, 5, 10, 15, 20)
INDICATORS = [
    (
        "i",
        f"100 * {div('close - ' + roll('min', 'low', 14), roll('max', 'high', 14) + ' - ' + roll('min', 'low', 14))} AS rsi, "
        f"{roll('avg', 'close', 12)} - {roll('avg', 'close', 26)} AS macd",
        "bars",
    ),
    ("j", f"{roll('avg', 'macd', 9)} AS macd_signal", "i"),
]

ORACLES = {
    "t01_band_position": _bands_sql(),
    "t04_on_balance_volume": _chain(
        [
            ("a", "sign(close - lag(close) OVER e) * volume AS x", "bars"),
            ("b", "CASE WHEN x IS NOT NULL THEN sum(x) OVER c END AS obv", "a"),
            ("d", f"{roll('avg', 'obv', 10)} AS obv_ma_10, obv - lag(obv, 5) OVER e AS obv_momentum", "b"),
        ],
        (10,),
        ["obv", "obv_ma_10", "obv_momentum"],
    ),
    "t05_volume_price_trend": _chain(
        [
            ("a", f"volume * {_change('close', 1)} AS x", "bars"),
            ("b", "CASE WHEN x IS NOT NULL THEN sum(x) OVER c END AS vpt", "a"),
            ("d", f"{roll('avg', 'vpt', 10)} AS vpt_ma_10", "b"),
        ],
        (10,),
        ["vpt", "vpt_ma_10"],
    ),
    "t06_accumulation_line": _chain(
        [
            ("a", f"{FLOW} AS x", "bars"),
            ("b", "sum(x) OVER c AS ad_line", "a"),
            ("d", f"{roll('avg', 'ad_line', 10)} AS ad_line_ma_10", "b"),
        ],
        (10,),
        ["ad_line", "ad_line_ma_10"],
    ),
    "t07_money_flow_ratio": _chain(
        [
            ("a", f"{FLOW} AS x", "bars"),
            ("b", f"{div(roll('sum', 'x', 20), roll('sum', 'volume', 20))} AS cmf_20", "a"),
        ],
        (20,),
        ["cmf_20"],
    ),
    "t08_volume_weighted_means": _chain(
        [
            ("a", "close * volume AS x", "bars"),
            (
                "b",
                ", ".join(
                    f"{div(roll('sum', 'x', p), roll('sum', 'volume', p))} AS vwma_{p}" for p in (10, 20)
                ),
                "a",
            ),
            (
                "d",
                ", ".join(f"({div('close', f'vwma_{p}')} - 1) * 100 AS price_to_vwma_{p}" for p in (10, 20)),
                "b",
            ),
        ],
        (10, 20),
        ["vwma_10", "vwma_20", "price_to_vwma_10", "price_to_vwma_20"],
    ),
    "t09_volume_ratios": _chain(
        [
            (
                "a",
                ", ".join(
                    [f"{div('volume', roll('avg', 'volume', p))} AS volume_ratio_{p}" for p in (5, 10, 20)]
                    + [f"{_change('volume', p)} * 100 AS volume_roc_{p}" for p in (5, 10)]
                ),
                "bars",
            )
        ],
        (5, 10, 20),
        ["volume_ratio_5", "volume_ratio_10", "volume_ratio_20", "volume_roc_5", "volume_roc_10"],
    ),
    "t10_money_flow_index": _chain(
        [
            ("a", f"{TYPICAL} AS tp", "bars"),
            (
                "b",
                "CASE WHEN tp > lag(tp) OVER e THEN tp * volume ELSE 0 END AS up, "
                "CASE WHEN tp < lag(tp) OVER e THEN tp * volume ELSE 0 END AS dn",
                "a",
            ),
            ("d", f"100 - 100 / (1 + {roll('sum', 'up', 14)} / ({roll('sum', 'dn', 14)} + 1e-10)) AS mfi", "b"),
        ],
        (14,),
        ["mfi"],
    ),
    "t11_rsi_states": _chain(
        [
            *INDICATORS,
            (
                "d",
                f"{flag('rsi > 70')} AS rsi_overbought, {flag('rsi < 30')} AS rsi_oversold, "
                f"{flag('(rsi - lag(rsi, 5) OVER e) * ' + _change('close', 5) + ' < 0')} AS rsi_divergence, "
                "rsi - lag(rsi, 3) OVER e AS rsi_momentum",
                "j",
            ),
        ],
        (9, 12, 14, 26),
        ["rsi_momentum"],
        ["rsi_overbought", "rsi_oversold", "rsi_divergence"],
    ),
    "t12_macd_crosses": _chain(
        [
            *INDICATORS,
            (
                "d",
                f"{flag('macd > macd_signal AND lag(macd) OVER e <= lag(macd_signal) OVER e')} AS macd_bullish_cross, "
                f"{flag('macd < macd_signal AND lag(macd) OVER e >= lag(macd_signal) OVER e')} AS macd_bearish_cross, "
                "(macd - macd_signal) - lag(macd - macd_signal, 3) OVER e AS macd_momentum",
                "j",
            ),
        ],
        (9, 12, 14, 26),
        ["macd_momentum"],
        ["macd_bullish_cross", "macd_bearish_cross"],
    ),
    "t13_momentum": _chain(
        [
            ("a", ", ".join(f"{_change('close', p)} * 100 AS momentum_{p}" for p in (1, 5, 10, 20)), "bars"),
            (
                "b",
                ", ".join(f"momentum_{p} - lag(momentum_{p}, 5) OVER e AS acceleration_{p}" for p in (5, 10)),
                "a",
            ),
        ],
        (),
        ["momentum_1", "momentum_5", "momentum_10", "momentum_20", "acceleration_5", "acceleration_10"],
    ),
    "t14_channel_index": _chain(
        [
            ("a", f"{TYPICAL} AS tp", "bars"),
            ("b", f"{roll('avg', 'tp', 20)} AS m, list(tp) OVER w20 AS held", "a"),
            (
                "d",
                "(tp - m) / nullif(0.015 * list_sum(list_transform(held, lambda v: abs(v - m))) / 20, 0) AS cci",
                "b",
            ),
        ],
        (20,),
        ["cci"],
    ),
    "t15_rates_of_change": _chain(
        [
            ("a", ", ".join(f"{_change('close', p)} * 100 AS roc_{p}" for p in ROC), "bars"),
            ("b", "list(roc_5) OVER c AS h_roc_5, list(roc_10) OVER c AS h_roc_10", "a"),
            ("d", f"{_weighted('roc_5', 3)} AS roc_ema_5, {_weighted('roc_10', 5)} AS roc_ema_10", "b"),
        ],
        (),
        [*[f"roc_{p}" for p in ROC], "roc_ema_5", "roc_ema_10"],
    ),
    "t16_candle_ratios": _chain(
        [
            (
                "a",
                "abs(close - open) / (high - low + 1e-10) AS body_ratio, "
                "(high - greatest(close, open)) / (high - low + 1e-10) AS upper_shadow_ratio, "
                "(least(close, open) - low) / (high - low + 1e-10) AS lower_shadow_ratio",
                "bars",
            )
        ],
        (),
        ["body_ratio", "upper_shadow_ratio", "lower_shadow_ratio"],
    ),
    "t17_gaps_and_inside_bars": _chain(
        [
            (
                "a",
                f"{flag('open > lag(close) OVER e')} AS gap_up, {flag('open < lag(close) OVER e')} AS gap_down, "
                f"{flag('high < lag(high) OVER e AND low > lag(low) OVER e')} AS inside_bar, "
                f"{flag('high > lag(high) OVER e AND low < lag(low) OVER e')} AS outside_bar",
                "bars",
            )
        ],
        (),
        [],
        ["gap_up", "gap_down", "inside_bar", "outside_bar"],
    ),
    "t18_doji_hammer": _chain(
        [
            (
                "a",
                f"{flag('abs(close - open) / (high - low + 1e-10) < 0.1')} AS doji, "
                + flag(
                    "least(close, open) - low > 2 * abs(close - open) "
                    "AND high - greatest(close, open) < abs(close - open)"
                )
                + " AS hammer",
                "bars",
            )
        ],
        (),
        [],
        ["doji", "hammer"],
    ),
    "t19_volatility": _chain(
        [
            ("a", f"{_change('close', 1)} AS r", "bars"),
            (
                "b",
                ", ".join(
                    f"{roll('stddev_samp', 'r', p)} * sqrt(252) * 100 AS volatility_{p}" for p in (5, 10, 20, 50)
                ),
                "a",
            ),
            ("d", f"{div('volatility_20', roll('avg', 'volatility_20', 50))} AS normalized_volatility", "b"),
        ],
        (5, 10, 20, 50),
        [*[f"volatility_{p}" for p in (5, 10, 20, 50)], "normalized_volatility"],
    ),
    "t20_true_range": _chain(
        [
            (
                "a",
                "CASE WHEN lag(close) OVER e IS NOT NULL THEN greatest(high - low, "
                "abs(high - lag(close) OVER e), abs(low - lag(close) OVER e)) END AS true_range",
                "bars",
            ),
            ("b", ", ".join(f"{roll('avg', 'true_range', p)} AS atr_{p}" for p in (14, 21)), "a"),
        ],
        (14, 21),
        ["true_range", "atr_14", "atr_21"],
    ),
    "t21_pivot_levels": _chain(
        [
            ("a", f"{roll('max', 'high', 20)} AS t, {roll('min', 'low', 20)} AS b", "bars"),
            (
                "d",
                "(t + b + close) / 3 AS pivot_point, 2 * ((t + b + close) / 3) - b AS resistance_1, "
                "2 * ((t + b + close) / 3) - t AS support_1",
                "a",
            ),
            (
                "f",
                f"{div('resistance_1 - close', 'close')} * 100 AS distance_to_resistance, "
                f"{div('close - support_1', 'close')} * 100 AS distance_to_support",
                "d",
            ),
        ],
        (20,),
        ["pivot_point", "resistance_1", "support_1", "distance_to_resistance", "distance_to_support"],
    ),
    "t22_local_extrema": "WITH "
    + HOURLY_BARS
    + " SELECT symbol, CAST(bar_ts AS VARCHAR) AS bar_ts, "
    + ", ".join(
        f"{flag(f'count(high) OVER z{k} = {2 * k + 1} AND {f} OVER z{k} = {x}')} AS {name}_{k}"
        for k in (5, 10)
        for name, f, x in (("local_max", "max(high)", "high"), ("local_min", "min(low)", "low"))
    )
    + " FROM bars WINDOW "
    + ", ".join(
        f"z{k} AS (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)"
        for k in (5, 10)
    ),
    "t23_clock_cycles": _chain(
        [
            (
                "a",
                ", ".join(
                    f"{fn}(2 * pi() * {x} / {cycle}) AS {name}_{fn}"
                    for name, x, cycle in (
                        ("hour", "hour(bar_ts)", 24),
                        ("dow", "(isodow(bar_ts) - 1)", 7),
                        ("dom", "day(bar_ts)", 31),
                        ("month", "month(bar_ts)", 12),
                    )
                    for fn in ("sin", "cos")
                ),
                "bars",
            )
        ],
        (),
        [f"{n}_{fn}" for n in ("hour", "dow", "dom", "month") for fn in ("sin", "cos")],
    ),
    "t24_sessions": _chain(
        [
            (
                "a",
                f"{flag('hour(bar_ts) >= 9 AND hour(bar_ts) < 16')} AS market_open, "
                f"{flag('hour(bar_ts) >= 4 AND hour(bar_ts) < 9')} AS pre_market, "
                f"{flag('hour(bar_ts) >= 16 OR hour(bar_ts) < 4')} AS after_hours",
                "bars",
            )
        ],
        (),
        [],
        ["market_open", "pre_market", "after_hours"],
    ),
}


def _split_bands() -> None:
    """Squeeze and breakouts also stand alone, so each is checked by itself."""
    for name, parts in (
        ("t02_band_squeeze", ("squeeze",)),
        ("t03_band_breakouts", ("breakout_up", "breakout_down")),
    ):
        picked = [f"bb_{p}_{x}" for p in (20, 50) for x in parts]

        def query(spark, folder, picked=picked):
            return QUERIES["t01_band_position"](spark, folder).select(*KEYS, *picked)

        QUERIES[name] = query
        ORACLES[name] = (
            f"SELECT {', '.join([*KEYS, *picked])} FROM ({ORACLES['t01_band_position']})"
        )


_split_bands()


def _joined_oracle() -> str:
    """All groups side by side, joined on the bar, plus the bar itself."""
    names = [n for n in ORACLES if n not in ("t02_band_squeeze", "t03_band_breakouts")]
    base = _chain([*INDICATORS], (9, 12, 14, 26), ["open", "high", "low", "close", "volume", "rsi", "macd", "macd_signal"])
    joins = " ".join(f"JOIN ({ORACLES[n]}) USING (symbol, bar_ts)" for n in names)
    return f"SELECT * FROM ({base}) {joins}"


ORACLES["technical_all"] = _joined_oracle()
