"""Queries and SQL for forecasts, signals and their metrics.

The predictions are made at every hourly bar: twelve steps of
close * (1 + (step - 6) / 190), which covers both directions and all
magnitudes without a value on a threshold.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import forecast as FC
from tickloom.operators import metrics as M
from tickloom.operators import prepare as P
from tickloom.operators import signals as G
from tickloom.plans import shapes
from tickloom.plans.present import present, sql_real
from tickloom.plans.sql_parts import HOURLY_BARS, final

KEYS = ["symbol", "asof_ts", "step"]


def _predictions(spark, folder):
    steps = F.explode(F.sequence(F.lit(1), F.lit(12))).alias("step")
    bars = shapes.hourly_bars(spark, folder)
    return bars.select("symbol", F.col("bar_ts").alias("asof_ts"), F.col("close").alias("current_price"), steps).withColumn(
        "predicted_price", F.col("current_price") * (1 + (F.col("step") - 6) / 190)
    )


def _classified(spark, folder):
    return G.classify(_predictions(spark, folder))


def _forecasts(method, steps=12):
    def make(spark, folder):
        return FC.baseline_forecasts(
            shapes.hourly_bars(spark, folder), shapes.hourly_series(spark, folder), method, steps
        )

    return make


_drift, _seasonal, _persistence = (_forecasts(m) for m in ("drift", "seasonal", "persistence"))


def _directions(spark, folder):
    return G.direction_only(_classified(spark, folder))


def _ensemble(with_trend):
    def query(spark, folder):
        made = _seasonal(spark, folder)
        directions = G.direction_only(G.classify(made))
        trends = G.trend_direction(made) if with_trend else None
        return present(G.ensemble(directions, trends).select(*KEYS, "direction", "confidence"))

    return query


def _signals(spark, folder):
    return G.trading_signals(_classified(spark, folder))


def _regression(spark, folder):
    """Least squares on close and volume for every step, fitted on the training part."""
    series = shapes.hourly_series(spark, folder)
    steps, features = range(1, 13), ["close", "volume"]
    df = FC.with_future_prices(shapes.hourly_bars(spark, folder), series, steps)
    df = P.time_split(df, series)
    models = FC.fit_pooled_regression(df.where("is_train"), features, steps)
    made = FC.regression_forecasts(df.where("NOT is_train"), models, features, ["symbol", "bar_ts"])
    return present(made.drop("current_price"))


def _bands(spark, folder):
    return present(FC.residual_bands(_drift(spark, folder), 12))


def _banded(spark, folder):
    made = _drift(spark, folder)
    df = FC.with_bands(made, FC.residual_bands(made, 12, (0.1, 0.5, 0.9)))
    return present(df.select(*KEYS, "predicted_price", "q10", "q50", "q90"))


QUERIES = {
    "d01_direction_classes": lambda s, d: present(_classified(s, d)),
    "d02_direction_only": lambda s, d: present(_directions(s, d)),
    "d03_trend_direction": lambda s, d: present(G.trend_direction(_seasonal(s, d))),
    "d04_ensemble": _ensemble(False),
    "d04_ensemble_with_trend": _ensemble(True),
    "d05_trading_signals": lambda s, d: present(_signals(s, d)),
    "d06_latest_directions": lambda s, d: present(G.latest_directions(_classified(s, d))),
    "d07_current_price": lambda s, d: present(G.current_prices(shapes.hourly_bars(s, d))),
    "o05_last_row": lambda s, d: present(
        G.current_prices(shapes.user_ticks(s, d), "user_id", "ts", "value").select(
            "user_id", "current_price"
        )
    ),
    "d08_signal_view": lambda s, d: present(G.signal_view(_signals(s, d), steps=5)),
    "f06_high_confidence": lambda s, d: present(G.high_confidence(_signals(s, d), 0.7)),
    "d09_persistence": lambda s, d: present(_persistence(s, d)),
    "d09_drift": lambda s, d: present(_drift(s, d)),
    "d09_seasonal": lambda s, d: present(_seasonal(s, d)),
    "d09_pooled_regression": _regression,
    "d10_residual_bands": _bands,
    "d10_forecast_bands": _banded,
    "g08_regression_metrics": lambda s, d: present(
        M.regression_metrics(_drift(s, d), "actual_price", "predicted_price", ["step"])
    ),
    "g09_direction_distribution": lambda s, d: present(M.direction_distribution(_classified(s, d))),
    "g10_prediction_summary": lambda s, d: present(M.prediction_summary(_classified(s, d), ["symbol"])),
    "g12_signal_summary": lambda s, d: present(M.signal_summary(_signals(s, d), ["symbol"])),
    "g13_direction_backtest": lambda s, d: present(
        M.direction_backtest(G.classify(_drift(s, d)), ["step"])
    ),
}

_MADE = f"""{HOURLY_BARS},
made AS (
  SELECT symbol, bar_ts AS asof_ts, CAST(step AS INTEGER) AS step, close AS current_price,
         close * (1 + (step - 6) / 190.0::DOUBLE) AS predicted_price
  FROM bars, generate_series(1, 12) t(step))"""

_CLASSES = """
moved AS (SELECT *, predicted_price - current_price AS price_change FROM {made}),
shares AS (SELECT *, price_change / nullif(current_price, 0) * 100 AS price_change_pct FROM moved),
named AS (
  SELECT *, CASE WHEN price_change > 0 THEN 'UP' WHEN price_change <= 0 THEN 'DOWN' END AS direction,
         CASE WHEN price_change_pct > 0.5 THEN 'UP' WHEN price_change_pct < -0.5 THEN 'DOWN'
              WHEN price_change_pct IS NOT NULL THEN 'NEUTRAL' END AS direction_confident,
         CASE WHEN abs(price_change_pct) > 2 THEN 'STRONG' WHEN abs(price_change_pct) > 1 THEN 'MODERATE'
              WHEN abs(price_change_pct) > 0.5 THEN 'WEAK'
              WHEN price_change_pct IS NOT NULL THEN 'MINIMAL' END AS magnitude,
         CASE WHEN price_change_pct IS NOT NULL
              THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (price_change_pct + 5) / 10)) END AS up_probability
  FROM shares),
classes AS (
  SELECT *, direction_confident || '_' || magnitude AS classification,
         1 - up_probability AS down_probability,
         CASE WHEN up_probability IS NOT NULL
              THEN greatest(up_probability, 1 - up_probability) END AS confidence
  FROM named)"""

_CLASSIFIED = f"{_MADE}, {_CLASSES.format(made='made')}"


def _baseline_ctes(method: str) -> str:
    over = "OVER (PARTITION BY symbol ORDER BY bar_ts)"
    if method == "persistence":
        made = {k: "close" for k in range(1, 13)}
    elif method == "drift":
        made = {k: f"close + {k} * (close - lag(close, 20) {over}) / 20" for k in range(1, 13)}
    else:
        made = {k: f"lag(close, {24 - k}) {over}" for k in range(1, 13)}
    rows = ", ".join(
        f"{{'step': {k}, 'p': {text}, 'a': lead(close, {k}) {over}}}" for k, text in made.items()
    )
    return f"""{HOURLY_BARS},
packed AS (SELECT symbol, bar_ts AS asof_ts, close AS current_price, unnest([{rows}]) AS r FROM bars),
forecast AS (SELECT symbol, asof_ts, CAST(r.step AS INTEGER) AS step, r.p AS predicted_price, current_price,
                    r.a AS actual_price FROM packed)"""


def _forecast_sql(method: str) -> str:
    return f"WITH {_baseline_ctes(method)} " + final(
        "forecast",
        ["asof_ts"],
        ["predicted_price", "current_price", "actual_price"],
        ["symbol", "step"],
    )


_TREND = """
trends AS (
  SELECT symbol, asof_ts, CASE WHEN count(predicted_price) > 1
              THEN regr_slope(predicted_price, step) END AS slope,
         CASE WHEN max(predicted_price) > min(predicted_price)
              THEN abs(corr(predicted_price, step)) END AS trend_confidence
  FROM {made} GROUP BY 1, 2),
trend_rows AS (
  SELECT *, CASE WHEN slope > 0 THEN 'UP' WHEN slope <= 0 THEN 'DOWN' END AS trend_direction FROM trends)"""

_SIGNAL_COLUMNS = (
    "signals AS (SELECT symbol, asof_ts, step, direction AS signal, confidence, magnitude AS strength, "
    "predicted_price AS price_target, price_change_pct AS change_percent FROM classes)"
)
_SIGNALS = f"{_CLASSIFIED}, {_SIGNAL_COLUMNS}"
_SIGNAL_REAL = ["confidence", "price_target", "change_percent"]
_SIGNAL_WHOLE = ["symbol", "step", "signal", "strength"]


def _bands_rows(levels) -> str:
    return " UNION ALL ".join(
        f"SELECT step, CAST({q} AS DOUBLE) AS level, quantile_cont(actual_price - predicted_price, {q}) AS residual "
        "FROM forecast GROUP BY step"
        for q in levels
    )


_PREDICTED = ["predicted_price", "current_price", "price_change", "price_change_pct"]
_PROBABILITY = ["up_probability", "down_probability"]
_NAMES = ["direction", "direction_confident", "magnitude", "classification"]

ORACLES = {
    "d01_direction_classes": f"WITH {_CLASSIFIED} "
    + final("classes", ["asof_ts"], [*_PREDICTED, *_PROBABILITY], ["symbol", "step", *_NAMES]),
    "d02_direction_only": f"WITH {_CLASSIFIED} "
    + final(
        "classes",
        ["asof_ts"],
        [*_PROBABILITY, "price_change_pct", "confidence"],
        ["symbol", "step", "direction", "direction_confident", "classification"],
    ),
    "d03_trend_direction": f"WITH {_baseline_ctes('seasonal')}, {_TREND.format(made='forecast')} "
    + final("trend_rows", ["asof_ts"], ["slope", "trend_confidence"], ["symbol", "trend_direction"]),
    "d04_ensemble": f"WITH {_baseline_ctes('seasonal')}, {_CLASSES.format(made='forecast')}, "
    "e AS (SELECT symbol, asof_ts, step, confidence, CASE WHEN direction IS NULL THEN NULL "
    "WHEN confidence > 0.7 THEN direction ELSE 'NEUTRAL' END AS direction FROM classes) "
    + final("e", ["asof_ts"], ["confidence"], ["symbol", "step", "direction"]),
    "d04_ensemble_with_trend": f"WITH {_baseline_ctes('seasonal')}, {_CLASSES.format(made='forecast')}, "
    f"{_TREND.format(made='forecast')}, "
    "e AS (SELECT symbol, asof_ts, step, confidence, CASE WHEN direction IS NULL THEN NULL "
    "WHEN confidence > 0.7 AND trend_direction = direction THEN direction ELSE 'NEUTRAL' END AS direction "
    "FROM classes JOIN trend_rows USING (symbol, asof_ts)) "
    + final("e", ["asof_ts"], ["confidence"], ["symbol", "step", "direction"]),
    "d05_trading_signals": f"WITH {_SIGNALS} "
    + final("signals", ["asof_ts"], _SIGNAL_REAL, _SIGNAL_WHOLE),
    "d06_latest_directions": f"WITH {_CLASSIFIED} "
    + final(
        "classes",
        ["asof_ts"],
        ["predicted_price", "price_change_pct", "up_probability"],
        ["symbol", "step", "direction", "direction_confident", "classification"],
    ),
    "d07_current_price": f"WITH {HOURLY_BARS}, l AS (SELECT symbol, max(bar_ts) AS asof_ts, "
    "arg_max(close, bar_ts) AS current_price FROM bars GROUP BY 1) "
    + final("l", ["asof_ts"], ["current_price"], ["symbol"]),
    "o05_last_row": f"SELECT user_id, {sql_real('arg_max(value, ts)', 'current_price')} FROM events GROUP BY 1",
    "d08_signal_view": f"WITH {_SIGNALS}, v AS (SELECT *, step AS place, "
    "CAST(floor(confidence * 5) AS INTEGER) AS grade, "
    "CAST(coalesce(confidence > 0.8, FALSE) AS INTEGER) AS high_confidence FROM signals WHERE step <= 5) "
    + final("v", ["asof_ts"], _SIGNAL_REAL, [*_SIGNAL_WHOLE, "place", "grade", "high_confidence"]),
    "f06_high_confidence": f"WITH {_SIGNALS} "
    + final("signals", ["asof_ts"], _SIGNAL_REAL, _SIGNAL_WHOLE)
    + " WHERE confidence > 0.7",
    "d09_persistence": _forecast_sql("persistence"),
    "d09_drift": _forecast_sql("drift"),
    "d09_seasonal": _forecast_sql("seasonal"),
    "d09_pooled_regression": f"WITH {HOURLY_BARS}, "
    + """
ahead AS (
  SELECT symbol, bar_ts, close, volume,
         row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) - 1
           < floor(0.8 * count(*) OVER (PARTITION BY symbol)) AS is_train,
         unnest(["""
    + ", ".join(f"{{'step': {k}, 'a': lead(close, {k}) OVER (PARTITION BY symbol ORDER BY bar_ts)}}" for k in range(1, 13))
    + """]) AS r
  FROM bars),
rows AS (SELECT symbol, bar_ts, close, volume, is_train, CAST(r.step AS INTEGER) AS step, r.a AS actual_price FROM ahead),
moments AS (SELECT step, avg(close) AS mx, avg(volume) AS mz, avg(actual_price) AS my, var_pop(close) AS xx,
                   var_pop(volume) AS zz, covar_pop(close, volume) AS xz, covar_pop(close, actual_price) AS xy,
                   covar_pop(volume, actual_price) AS zy
            FROM rows WHERE is_train AND actual_price IS NOT NULL GROUP BY 1),
lines AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS d FROM moments),
made AS (SELECT symbol, bar_ts, step, my + b * (close - mx) + d * (volume - mz) AS predicted_price, actual_price
         FROM rows JOIN lines USING (step) WHERE NOT is_train) """
    + final("made", ["bar_ts"], ["predicted_price", "actual_price"], ["symbol", "step"]),
    "d10_residual_bands": f"WITH {_baseline_ctes('drift')}, b AS ({_bands_rows(FC.BAND_LEVELS)}) "
    + final("b", [], ["level", "residual"], ["step"]),
    "d10_forecast_bands": f"WITH {_baseline_ctes('drift')}, b AS (SELECT step, "
    + ", ".join(
        f"quantile_cont(actual_price - predicted_price, {q}) AS r{n}" for q, n in ((0.1, 10), (0.5, 50), (0.9, 90))
    )
    + " FROM forecast GROUP BY step), f AS (SELECT forecast.*, "
    + ", ".join(f"predicted_price + r{n} AS q{n}" for n in (10, 50, 90))
    + " FROM forecast JOIN b USING (step)) "
    + final("f", ["asof_ts"], ["predicted_price", "q10", "q50", "q90"], ["symbol", "step"]),
    "g08_regression_metrics": f"WITH {_baseline_ctes('drift')}, m AS (SELECT step, "
    "avg(abs(actual_price - predicted_price)) AS mae, avg((actual_price - predicted_price) ** 2) AS mse, "
    "sqrt(avg((actual_price - predicted_price) ** 2)) AS rmse, "
    "100 * coalesce(avg(abs((actual_price - predicted_price) / actual_price)) "
    "FILTER (abs(actual_price) > 1e-8), 0) AS mape, count(*) AS n "
    "FROM forecast WHERE actual_price IS NOT NULL AND predicted_price IS NOT NULL GROUP BY 1) "
    + final("m", [], ["mae", "mse", "rmse", "mape"], ["step", "n"]),
    "g09_direction_distribution": f"WITH {_CLASSIFIED} SELECT direction, count(*) AS count, "
    + sql_real("100.0 * count(*) / sum(count(*)) OVER ()", "percentage")
    + " FROM classes GROUP BY direction",
    "g10_prediction_summary": f"WITH {_CLASSIFIED}, t AS (SELECT symbol, avg(predicted_price) AS avg_predicted_price, "
    "max(predicted_price) - min(predicted_price) AS price_range, "
    + ", ".join(
        f"nullif(count(*) FILTER (direction = '{d}'), 0)::DOUBLE AS direction_{d.lower()}_count, "
        f"100.0 * nullif(count(*) FILTER (direction = '{d}'), 0)::DOUBLE / count(*) AS direction_{d.lower()}_percentage"
        for d in ("UP", "DOWN")
    )
    + ", avg(confidence) AS avg_confidence FROM classes GROUP BY 1), "
    "u AS (UNPIVOT t ON COLUMNS(* EXCLUDE symbol) INTO NAME metric VALUE v) "
    f"SELECT symbol, metric, {sql_real('v', 'value')} FROM u",
    "g12_signal_summary": f"WITH {_SIGNALS} SELECT symbol, count(*) FILTER (signal = 'UP') AS up_signals, "
    "count(*) FILTER (signal = 'DOWN') AS down_signals, "
    + sql_real("avg(confidence)", "avg_confidence")
    + ", count(*) FILTER (confidence > 0.8) AS high_confidence FROM signals GROUP BY 1",
    "g13_direction_backtest": f"WITH {_baseline_ctes('drift')}, {_CLASSES.format(made='forecast')}, "
    "k AS (SELECT *, CASE WHEN actual_price > current_price THEN 'UP' ELSE 'DOWN' END AS was FROM classes "
    "WHERE actual_price IS NOT NULL AND direction IS NOT NULL), "
    "s AS (SELECT step, count(*) AS total_predictions, "
    "count(*) FILTER (direction_confident <> 'NEUTRAL') AS confident_predictions, "
    "avg((direction = was)::INTEGER) AS overall_accuracy, "
    "avg((direction_confident = was)::INTEGER) FILTER (direction_confident <> 'NEUTRAL') AS confident_accuracy, "
    + ", ".join(
        f"avg((was = '{d}')::INTEGER) FILTER (direction = '{d}') AS precision_{d.lower()}, "
        f"avg((direction = '{d}')::INTEGER) FILTER (was = '{d}') AS recall_{d.lower()}"
        for d in ("UP", "DOWN")
    )
    + " FROM k GROUP BY 1), f AS (SELECT *, "
    + ", ".join(
        f"2 * precision_{d} * recall_{d} / nullif(precision_{d} + recall_{d}, 0) AS f1_{d}" for d in ("up", "down")
    )
    + " FROM s) "
    + final(
        "f",
        [],
        ["overall_accuracy", "confident_accuracy"]
        + [f"{m}_{d}" for d in ("up", "down") for m in ("precision", "recall", "f1")],
        ["step", "total_predictions", "confident_predictions"],
    ),
}
