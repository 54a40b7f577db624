"""Queries and SQL for filters, whole-table statistics and training tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import prepare as P
from tickloom.operators import statistics as S
from tickloom.operators.technical import technical_features
from tickloom.plans import shapes
from tickloom.plans.present import present, sql_real
from tickloom.plans.shapes import USER_SERIES
from tickloom.plans.sql_parts import HOURLY_BARS, div, final, flag, roll, single, windows
from tickloom.plans.training_table import TrainingPlan, build_training_table
from tickloom.sources.tables import of_symbol, project

KEYS = ["symbol", "bar_ts"]
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
RANKED = ["momentum_5", "volume_ratio_5", "body_ratio", "bb_20_position", "true_range"]


def _bars_and_features(spark, folder):
    bars = shapes.hourly_bars(spark, folder)
    series = shapes.hourly_series(spark, folder)
    groups = ["bands", "volume_ratios", "momentum", "candles", "true_ranges"]
    return technical_features(bars, series, groups=groups), series


def _with_target(spark, folder):
    df, series = _bars_and_features(spark, folder)
    df = df.select(*KEYS, "close", "volume", *RANKED)
    return P.with_target(df, series, horizon=12), series


# --- filters ----------------------------------------------------------------


def _symbol_filter(spark, folder):
    return present(of_symbol(shapes.hourly_bars(spark, folder), "view"))


def _present_keys(spark, folder):
    ticks = shapes.table(spark, folder, "events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("ts")).alias("ts"), "value"
    )
    return present(ticks.dropna(subset=["ts"]).select("event_id", "value"))


def _target_rows(spark, folder):
    df, _ = _with_target(spark, folder)
    return present(df.select(*KEYS, "target"))


def _aligned(spark, folder):
    df, _ = _with_target(spark, folder)
    return present(P.aligned_rows(df, RANKED).select(*KEYS, "target", *RANKED))


def _wild_ticks(spark, folder):
    kind = F.col("event_type")
    wild = (
        F.when(kind == "error", F.lit(float("inf")))
        .when(kind == "view", F.lit(float("-inf")))
        .when(kind == "signup", F.lit(float("nan")))
        .otherwise(F.col("value"))
    )
    events = shapes.table(spark, folder, "events")
    return events.select("event_id", wild.alias("value"))


def _projected(spark, folder):
    bars = shapes.hourly_bars(spark, folder)
    return present(project(bars, ["symbol", "bar_ts", "close", "symbol", "absent", "open", "close"]))


def _enough_rows(spark, folder):
    bars = P.require_rows(shapes.hourly_bars(spark, folder), 100)
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))


def _split(spark, folder):
    bars = shapes.hourly_bars(spark, folder)
    df = P.time_split(bars, shapes.hourly_series(spark, folder))
    return present(df.select(*KEYS, F.col("is_train").cast("int").alias("is_train")))


# --- statistics -------------------------------------------------------------


def _lines(spark, folder):
    return shapes.table(spark, folder, "lineitem")


def _distinct(spark, folder):
    columns = [*LINE_NUMBERS, "l_returnflag", "l_linestatus"]
    return present(S.distinct_ratios(_lines(spark, folder), columns), 9)


def _shares(spark, folder):
    df, _ = _bars_and_features(spark, folder)
    return present(S.present_shares(df, RANKED))


def _quartiles(most_groups):
    def query(spark, folder):
        df = _lines(spark, folder)
        found = S.exact_quantiles(df, LINE_NUMBERS, (0.25, 0.5, 0.75), most_groups)
        rows = [(c, *[found[c, q] for q in (0.25, 0.5, 0.75)]) for c in LINE_NUMBERS]
        table = spark.createDataFrame(rows, "feature string, q25 double, median double, q75 double")
        return present(table)

    return query


def _modes(spark, folder):
    return S.modes(_lines(spark, folder), ["l_discount", "l_tax", "l_returnflag", "l_linestatus"])


def _missing(spark, folder):
    df, _ = _bars_and_features(spark, folder)
    return present(S.missing_percentage(df, [*KEYS, *RANKED]))


def _coverage(spark, folder):
    df, _ = _bars_and_features(spark, folder)
    return present(S.coverage_report(df, "bar_ts", RANKED, ["rsi", "willr"]))


# --- preparation ------------------------------------------------------------


def _static_info(spark, folder):
    nation = shapes.table(spark, folder, "nation")
    region = shapes.table(spark, folder, "region")
    info = (
        nation.where(F.col("n_regionkey") > 0)
        .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("n_nationkey").alias("symbol"),
            F.col("r_name").alias("sector"),
            F.col("n_name").alias("industry"),
            (F.col("n_nationkey") % 2).cast("int").alias("dividend_paying"),
        )
    )
    customers = shapes.table(spark, folder, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("symbol")
    )
    defaults = {k: P.STATIC_DEFAULTS[k] for k in ("sector", "industry", "dividend_paying")}
    return P.with_static_info(customers, info, defaults=defaults)


ROLE_COLUMNS = ["open", "close", "volume", "market_open", "pre_market", "sector"]


def _role_facts(spark, folder):
    series = shapes.hourly_series(spark, folder)
    df = technical_features(shapes.hourly_bars(spark, folder), series, groups=["sessions"])
    df = df.withColumn("sector", F.lit("Technology"))
    return present(P.name_roles(S.distinct_ratios(df, ROLE_COLUMNS)), 9)


def _assigned(compatible):
    def query(spark, folder):
        series = shapes.hourly_series(spark, folder)
        df = technical_features(shapes.hourly_bars(spark, folder), series, groups=["sessions"])
        df = df.withColumn("sector", F.lit("Technology"))
        roles = P.assign_roles(df, skip=KEYS, target="close", compatible=compatible)
        return roles.table(df)

    return query


def _lagged(spark, folder):
    events = shapes.table(spark, folder, "events").select("user_id", "ts", "event_id", "value")
    df = P.with_lags(events, USER_SERIES, ["value"], (1, 3, 5, 10, 20), keep=["event_id"])
    return present(df)


def _interactions(spark, folder):
    """All kinds of pairs, from columns made of the bars' prices."""
    bars = shapes.hourly_bars(spark, folder).selectExpr(
        "*", "high - low AS vix_level", "high - close AS atr_14", "close - low AS sent_mean",
        "open - low AS rsi_14", "open - close AS macd_histogram",
    )
    df = P.with_interactions(bars, P.interaction_pairs(bars.columns))
    return present(df.select("symbol", "bar_ts", *[c for c in df.columns if c not in bars.columns]))


def _encoded(spark, folder):
    orders = shapes.table(spark, folder, "orders").select(
        "o_orderkey",
        "o_orderpriority",
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus"),
    )
    seen = orders.where(F.col("o_orderpriority") != "5-LOW")
    return P.fit_labels(seen, ["o_orderpriority", "o_orderstatus"]).transform(orders)


def _selected(spark, folder):
    df, _ = _with_target(spark, folder)
    roles = P.Roles([], [], RANKED, ["close"])
    chosen = P.select_features(df, roles, "target", {"unknown_future": 3})
    rows = [(c, role) for role, cs in chosen.items() for c in cs]
    return spark.createDataFrame(rows, "feature string, role string")


def _scaled(spark, folder):
    lines = _lines(spark, folder)
    scaler = P.fit_scaler(lines, LINE_NUMBERS)
    df = scaler.transform(lines.select("l_orderkey", "l_partkey", "l_linenumber", *LINE_NUMBERS))
    return present(df)


def _targets(spark, folder):
    df, _ = _with_target(spark, folder)
    return present(df.select(*KEYS, "close", "target", "time_idx"))


def _gappy(spark, folder):
    events = shapes.table(spark, folder, "events")
    kind = F.col("event_type")
    return events.select(
        "user_id",
        "ts",
        "event_id",
        F.when(kind != "signup", F.col("value")).alias("target"),
        F.when(kind != "error", F.col("value")).alias("close"),
        F.when(kind == "view", F.lit(float("inf")))
        .when(kind != "click", F.col("value"))
        .alias("feature"),
        F.when(kind != "view", kind).alias("label"),
    )


def _gap_filled(spark, folder):
    df = _gappy(spark, folder)
    df = P.all_finite(df)
    medians, modes = P.fitted_fill(df, ["feature", "label"])
    filled = P.fill_gaps(df, USER_SERIES, ["feature", "label"], medians=medians, modes=modes)
    return present(filled.select("event_id", "feature", "label"))


def _cleaned(spark, folder):
    df = P.clean_training_table(_gappy(spark, folder), USER_SERIES, min_rows=100)
    return present(df.select("event_id", "target", "close", "feature", "label"))


def _clean_check(spark, folder):
    """Gaps before and after cleaning."""
    raw = _gappy(spark, folder)
    clean = P.clean_training_table(raw, USER_SERIES, min_rows=100)
    stages = {"raw": raw, "clean": clean}
    first, second = (P.remaining_gaps(df).withColumn("stage", F.lit(n)) for n, df in stages.items())
    return first.unionByName(second)


def _importance(spark, folder):
    df, _ = _with_target(spark, folder)
    return present(P.mutual_information(df, RANKED, "target", precise=True))


def _ranked(spark, folder):
    df, _ = _with_target(spark, folder)
    scores = P.mutual_information(df, RANKED, "target").withColumn("role", F.lit("unknown_future"))
    return scores


def _sorted_scores(spark, folder):
    """With the place of each row in the sorted output."""
    df = _ranked(spark, folder).orderBy(F.col("importance_score").desc(), "feature")
    return present(P.with_position(df))


def _top_per_role(spark, folder):
    df = P.top_features(_ranked(spark, folder), {"unknown_future": 3})
    return present(df)


def _top_two(spark, folder):
    df = _ranked(spark, folder).orderBy(F.col("importance_score").desc(), "feature").limit(2)
    return present(df)


def _sequences(last_only):
    def query(spark, folder):
        df, series = _with_target(spark, folder)
        out = P.sequence_samples(
            df,
            series,
            history=["close", "momentum_5"],
            future=["volume"],
            last_only=last_only,
        )
        add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
        return present(
            out.select(
                *KEYS,
                "encoder_length",
                "decoder_length",
                add(F.transform("history", lambda h: h["close"])).alias("history_sum"),
                F.get("history", F.lit(0))["relative_idx"].alias("first_idx"),
                F.get("horizon", F.lit(0)).alias("next_target"),
                add("horizon").alias("horizon_sum"),
                add(F.transform("known", lambda k: k["volume"])).alias("known_sum"),
            )
        )

    return query


def _target_scale(spark, folder):
    df, series = _with_target(spark, folder)
    df = P.with_target_scale(df, series)
    return present(df.select(*KEYS, "target_center", "target_scale"))


def _time_sorted(spark, folder):
    """With the place of each row in the sorted output."""
    bars = shapes.hourly_bars(spark, folder)
    return present(P.with_position(bars.orderBy("symbol", "bar_ts").select(*KEYS, "close")))


def _training(spark, folder):
    series = shapes.hourly_series(spark, folder)
    plan = TrainingPlan(
        technical_groups=["volume_ratios", "momentum", "candles", "clock", "sessions"],
        lag_periods=(1, 5),
        max_features={"unknown_future": 12, "known_future": 8, "static": 4},
    )
    symbols = shapes.table(spark, folder, "events").select(F.col("event_type").alias("symbol"))
    info = symbols.distinct().withColumn("sector", F.upper("symbol"))
    made = build_training_table(shapes.hourly_bars(spark, folder), series, plan, info=info)
    return present(made.table.select(*KEYS, "time_idx", "target"))


def _training_features(spark, folder):
    """Selected, scaled and filled features of a plan small enough for SQL."""
    series = shapes.hourly_series(spark, folder)
    plan = TrainingPlan(
        technical_groups=["momentum"],
        include_events=False,
        lag_periods=(1,),
        interactions=[("close", "volume")],
        max_features={"unknown_future": 99, "known_future": 99, "static": 99},
    )
    made = build_training_table(shapes.hourly_bars(spark, folder), series, plan)
    return present(made.table.select(*KEYS, "is_train", "target", "momentum_5", "close_lag_1", "close_x_volume"))


QUERIES = {
    "f01_symbol_filter": _symbol_filter,
    "f02_present_keys": _present_keys,
    "f03_present_target": _target_rows,
    "f04_finite_values": lambda s, d: present(P.all_finite(_wild_ticks(s, d))),
    "f05_projection": _projected,
    "f07_minimum_size": _enough_rows,
    "f08_time_split": _split,
    "g03_distinct_ratio": _distinct,
    "g04_present_share": _shares,
    "g05_quartiles": _quartiles(S.MOST_GROUPS),
    "g05_quartiles_narrowed": _quartiles(1_000),
    "g06_mode": _modes,
    "g07_missing_share": _missing,
    "a12_coverage_report": _coverage,
    "p01_static_covariates": _static_info,
    "j10_static_lookup": lambda s, d: _static_info(s, d).groupBy("sector").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("dividend_paying").alias("paying")
    ),
    "j11_aligned_rows": _aligned,
    "p02_role_facts": _role_facts,
    "p02_roles": _assigned(False),
    "p02_roles_compatible": _assigned(True),
    "p03_lags": _lagged,
    "p04_interactions": _interactions,
    "p05_label_codes": _encoded,
    "p06_feature_selection": _selected,
    "p07_robust_scaling": _scaled,
    "p08_horizon_target": _targets,
    "p09_gap_filling": _gap_filled,
    "p10_feature_importance": _importance,
    "p11_cleaned_table": _cleaned,
    "p11_remaining_gaps": _clean_check,
    "p12_sequences": _sequences(False),
    "p12_last_sequence": _sequences(True),
    "p13_target_scale": _target_scale,
    "p14_training_table": _training,
    "p14_training_features": _training_features,
    "o01_time_sort": _time_sorted,
    "o02_score_sort": _sorted_scores,
    "o03_top_per_role": _top_per_role,
    "o04_top_features": _top_two,
}


# --- SQL --------------------------------------------------------------------


def _change(x: str, k: int) -> str:
    return f"({div(x, f'lag({x}, {k}) OVER e')} - 1)"


_FEATURES = f"""{HOURLY_BARS},
mid AS (SELECT *, {roll('avg', 'close', 20)} AS m, {roll('stddev_samp', 'close', 20)} AS d
        FROM bars {windows(sizes=(20,))}),
features AS (
  SELECT *, {_change('close', 5)} * 100 AS momentum_5,
         {div('volume', roll('avg', 'volume', 5))} AS volume_ratio_5,
         abs(close - open) / (high - low + 1e-10) AS body_ratio,
         {div('close - (m - 2*d)', '(m + 2*d) - (m - 2*d)')} AS bb_20_position,
         CASE WHEN lag(close) OVER e IS NOT NULL THEN greatest(high - low,
           abs(high - lag(close) OVER e), abs(low - lag(close) OVER e)) END AS true_range
  FROM mid {windows(sizes=(5,))})"""

_TARGETS = f"""{_FEATURES},
ahead AS (SELECT *, lead(close, 12) OVER (PARTITION BY symbol ORDER BY bar_ts) AS target FROM features),
targets AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) - 1 AS time_idx
            FROM ahead WHERE target IS NOT NULL)"""


def _each(columns, template: str) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in columns)


_DISTINCT = (
    "SELECT '{c}' AS feature, count(*) AS rows, count(DISTINCT {c}) AS distinct_values, "
    "count(DISTINCT {c}) / count(*)::DOUBLE AS distinct_ratio FROM "
)
_ROLE_SOURCE = f"""{HOURLY_BARS},
shown AS (SELECT *, {flag('hour(bar_ts) >= 9 AND hour(bar_ts) < 16')} AS market_open,
                 {flag('hour(bar_ts) >= 4 AND hour(bar_ts) < 9')} AS pre_market,
                 {flag('hour(bar_ts) >= 16 OR hour(bar_ts) < 4')} AS after_hours,
                 'Technology' AS sector FROM bars)"""


def _roles_sql(compatible: bool) -> str:
    names = ["open", "high", "low", "volume", "market_open", "pre_market", "after_hours", "sector"]
    known = ["market_open", "pre_market", "after_hours"]
    facts = _each(names, _DISTINCT + "shown")
    named = ", ".join(f"'{k}'" for k in known)
    if compatible:
        tests = (
            f"SELECT feature, 'static' AS role FROM facts WHERE feature = 'sector' OR distinct_ratio < 0.01 "
            f"UNION ALL SELECT feature, 'known_future' FROM facts WHERE feature IN ({named}) "
            f"UNION ALL SELECT feature, 'unknown_future' FROM facts WHERE feature <> 'sector' "
            f"AND distinct_ratio >= 0.01 AND feature NOT IN ({named})"
        )
    else:
        tests = (
            f"SELECT feature, CASE WHEN feature = 'sector' THEN 'static' WHEN feature IN ({named}) THEN 'known_future' "
            "WHEN distinct_ratio < 0.01 THEN 'static' ELSE 'unknown_future' END AS role FROM facts"
        )
    return f"WITH {_ROLE_SOURCE}, facts AS ({facts}) {tests} UNION ALL SELECT 'close', 'target'"


def _information(precise: bool = False) -> str:
    names = [*RANKED, "target"]
    if precise:
        filled = ", ".join([*[f"coalesce({c}, 0) AS {c}" for c in RANKED], "target"])
    else:
        filled = ", ".join(f"coalesce({single(c)}, 0) AS {c}" for c in names)
    cuts = ", ".join(
        f"quantile_cont({c}, [{', '.join(f'{i / 10}' for i in range(1, 10))}]) AS cut_{c}" for c in names
    )
    bins = ", ".join(
        f"len(list_filter(list_distinct(cut_{c}), lambda v: {c} > v)) AS b_{c}" for c in names
    )
    cells = _each(
        RANKED,
        "SELECT '{c}' AS feature, b_{c} AS bx, b_target AS byy, count(*) AS n FROM binned GROUP BY 2, 3",
    )
    return f"""{_TARGETS},
known AS (SELECT {filled} FROM targets),
cuts AS (SELECT {cuts} FROM known),
binned AS (SELECT {bins} FROM known, cuts),
cells AS ({cells}),
shares AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bx) AS nx,
                  sum(n) OVER (PARTITION BY feature, byy) AS ny FROM cells),
scores AS (SELECT feature, sum(n / t * ln(n * t / (nx * ny))) AS importance_score, 'unknown_future' AS role
           FROM shares GROUP BY feature),
ranked AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY importance_score DESC, feature) AS rank
           FROM scores)"""


_MEDIAN = "(SELECT quantile_cont({c}, 0.5) FROM {t})"
_GAPPY = """
gappy AS (
  SELECT user_id, ts, event_id, CASE WHEN event_type <> 'signup' THEN value END AS target,
         CASE WHEN event_type <> 'error' THEN value END AS close,
         CASE WHEN event_type NOT IN ('view', 'click') THEN value END AS feature,
         CASE WHEN event_type <> 'view' THEN event_type END AS label
  FROM events),
marked AS (SELECT * FROM gappy WHERE target IS NOT NULL)"""
_UP = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
_ON = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def _mode(column: str, source: str) -> str:
    return (
        f"(SELECT {column} FROM {source} WHERE {column} IS NOT NULL GROUP BY 1 "
        f"ORDER BY count(*) DESC, {column} LIMIT 1)"
    )


_SEQUENCES = f"""{_TARGETS},
held AS (
  SELECT *, list(close) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS 49 PRECEDING) AS past,
         list(target) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) AS nexts,
         list(volume) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) AS knowns
  FROM targets),
samples AS (
  SELECT symbol, bar_ts, CAST(len(past) AS INTEGER) AS encoder_length,
         CAST(len(nexts) AS INTEGER) AS decoder_length,
         list_sum(past) AS history_sum, CAST(1 - len(past) AS BIGINT) AS first_idx,
         nexts[1] AS next_target, list_sum(nexts) AS horizon_sum, list_sum(knowns) AS known_sum
  FROM held WHERE len(past) >= 25 AND len(nexts) >= 1)"""
_SEQ_REAL = ["history_sum", "next_target", "horizon_sum", "known_sum"]
_SEQ_WHOLE = ["symbol", "encoder_length", "decoder_length", "first_idx"]

_STATIC = """
info AS (SELECT n_nationkey AS symbol, r_name AS sector, n_name AS industry, n_nationkey % 2 AS dividend_paying
         FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey > 0),
looked AS (SELECT c_custkey, c_nationkey AS symbol, coalesce(sector, 'Unknown') AS sector,
                  coalesce(industry, 'Unknown') AS industry,
                  CAST(coalesce(dividend_paying, 0) AS INTEGER) AS dividend_paying
           FROM customer LEFT JOIN info ON c_nationkey = symbol)"""

_QUARTILES = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, "
    + ", ".join(
        sql_real(f"quantile_cont({c}, {q})", n) for q, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))
    )
    + " FROM lineitem"
    for c in LINE_NUMBERS
)

ORACLES = {
    "f01_symbol_filter": f"WITH {HOURLY_BARS} "
    + final("bars", ["bar_ts"], ["open", "high", "low", "close", "volume"], ["symbol"])
    + " WHERE symbol = 'view'",
    "f02_present_keys": f"SELECT event_id, {sql_real('value', 'value')} FROM events WHERE event_type <> 'error'",
    "f03_present_target": f"WITH {_TARGETS} " + final("targets", ["bar_ts"], ["target"], ["symbol"]),
    "f04_finite_values": "SELECT event_id, CASE WHEN event_type IN ('click', 'purchase') THEN "
    + sql_real("value", "value").replace(" AS value", "")
    + " END AS value FROM events",
    "f05_projection": f"WITH {HOURLY_BARS} " + final("bars", ["bar_ts"], ["close", "open"], ["symbol"]),
    "f07_minimum_size": f"WITH {HOURLY_BARS} SELECT symbol, count(*) AS bars FROM bars GROUP BY 1",
    "f08_time_split": f"""WITH {HOURLY_BARS} SELECT symbol, CAST(bar_ts AS VARCHAR) AS bar_ts,
CAST(row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) - 1
     < floor(0.8 * count(*) OVER (PARTITION BY symbol)) AS INTEGER) AS is_train FROM bars""",
    "g03_distinct_ratio": "WITH f AS ("
    + _each([*LINE_NUMBERS, "l_returnflag", "l_linestatus"], _DISTINCT + "lineitem")
    + f") SELECT feature, rows, distinct_values, {sql_real('distinct_ratio', 'distinct_ratio', 9)} FROM f",
    "g04_present_share": f"WITH {_FEATURES} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {sql_real(f'count({c}) / count(*)::DOUBLE', 'present_share')} FROM features"
        for c in RANKED
    ),
    "g05_quartiles": _QUARTILES,
    "g05_quartiles_narrowed": _QUARTILES,
    "g06_mode": " UNION ALL ".join(
        f"(SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS mode, count(*) AS copies FROM lineitem "
        f"GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
        for c in ("l_discount", "l_tax", "l_returnflag", "l_linestatus")
    ),
    "g07_missing_share": f"WITH {_FEATURES} SELECT "
    + sql_real(
        "100.0 * ("
        + " + ".join(f"count(*) - count({c})" for c in [*KEYS, *RANKED])
        + f") / (count(*) * {len(KEYS) + len(RANKED)})",
        "missing_percentage",
    )
    + " FROM features",
    "a12_coverage_report": f"WITH {_FEATURES} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {sql_real(f'100.0 * count({c}) / count(*)', 'coverage')}, "
        f"CAST(min(bar_ts) FILTER ({c} IS NOT NULL) AS VARCHAR) AS first_valid, "
        f"CAST(max(bar_ts) FILTER ({c} IS NOT NULL) AS VARCHAR) AS last_valid FROM features"
        for c in RANKED
    )
    + "".join(
        f" UNION ALL SELECT '{c}', CAST(0 AS DOUBLE), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)"
        for c in ("rsi", "willr")
    ),
    "p01_static_covariates": f"WITH {_STATIC} SELECT * FROM looked",
    "j10_static_lookup": f"WITH {_STATIC} SELECT sector, count(*) AS customers, "
    "CAST(sum(dividend_paying) AS BIGINT) AS paying FROM looked GROUP BY 1",
    "p02_role_facts": f"WITH {_ROLE_SOURCE}, f AS ({_each(ROLE_COLUMNS, _DISTINCT + 'shown')}) "
    f"SELECT feature, rows, distinct_values, {sql_real('distinct_ratio', 'distinct_ratio', 9)}, "
    "CAST(feature = 'sector' AS INTEGER) AS named_static, "
    "CAST(feature IN ('market_open', 'pre_market') AS INTEGER) AS named_known FROM f",
    "p02_roles": _roles_sql(False),
    "p02_roles_compatible": _roles_sql(True),
    "p03_lags": "SELECT event_id, "
    + ", ".join(
        sql_real(f"lag(value, {k}) OVER (PARTITION BY user_id ORDER BY ts, event_id)", f"value_lag_{k}")
        for k in (1, 3, 5, 10, 20)
    )
    + " FROM events",
    "p04_interactions": f"WITH {HOURLY_BARS} SELECT symbol, CAST(bar_ts AS VARCHAR) AS bar_ts, "
    + ", ".join(sql_real(f"{p} * volume", f"{p}_x_volume") for p in ("open", "high", "low", "close"))
    + ", " + ", ".join(sql_real(f"sent_mean * {v}", f"sent_mean_x_{v}") for v in ("vix_level", "atr_14"))
    + ", " + sql_real("rsi_14 * macd_histogram", "rsi_macd_combined")
    + " FROM (SELECT *, high - low AS vix_level, high - close AS atr_14, close - low AS sent_mean, "
    "open - low AS rsi_14, open - close AS macd_histogram FROM bars)",
    "p05_label_codes": """WITH t AS (
  SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderstatus = 'P' THEN 'Unknown' ELSE o_orderstatus END AS s
  FROM orders),
seen AS (SELECT * FROM t WHERE o_orderpriority <> '5-LOW'),
p AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code
      FROM (SELECT DISTINCT o_orderpriority FROM seen)),
q AS (SELECT s AS v, row_number() OVER (ORDER BY s) - 1 AS code FROM (SELECT DISTINCT s FROM seen))
SELECT o_orderkey, coalesce(p.code, (SELECT count(*) FROM p)) AS o_orderpriority, q.code AS o_orderstatus
FROM t LEFT JOIN p ON o_orderpriority = p.v LEFT JOIN q ON s = q.v""",
    "p06_feature_selection": f"WITH {_information()} SELECT feature, role FROM ranked WHERE rank <= 3",
    "p07_robust_scaling": "WITH f AS (SELECT "
    + ", ".join(
        f"quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS w_{c}"
        for c in LINE_NUMBERS
    )
    + " FROM lineitem) SELECT l_orderkey, l_partkey, l_linenumber, "
    + ", ".join(
        sql_real(f"({c} - m_{c}) / CASE WHEN w_{c} = 0 THEN 1 ELSE w_{c} END", c) for c in LINE_NUMBERS
    )
    + " FROM lineitem, f",
    "p08_horizon_target": f"WITH {_TARGETS} "
    + final("targets", ["bar_ts"], ["close", "target"], ["symbol", "time_idx"]),
    "p09_gap_filling": f"WITH {_GAPPY} SELECT event_id, "
    + sql_real(
        f"coalesce(last_value(feature IGNORE NULLS) {_UP}, {_MEDIAN.format(c='feature', t='gappy')})",
        "feature",
    )
    + f", coalesce(last_value(label IGNORE NULLS) {_UP}, {_mode('label', 'gappy')}) AS label FROM gappy",
    "p10_feature_importance": f"WITH {_information(precise=True)} SELECT feature, "
    + sql_real("importance_score", "importance_score")
    + " FROM scores",
    "p11_cleaned_table": f"WITH {_GAPPY} SELECT event_id, {sql_real('target', 'target')}, "
    + sql_real(
        f"coalesce(last_value(close IGNORE NULLS) {_UP}, first_value(close IGNORE NULLS) {_ON}, target)", "close"
    )
    + ", "
    + sql_real(f"coalesce(feature, {_MEDIAN.format(c='feature', t='marked')})", "feature")
    + f", coalesce(label, {_mode('label', 'marked')}) AS label FROM marked",
    "p11_remaining_gaps": f"WITH {_GAPPY} SELECT 'raw' AS stage, (SELECT count(*) FILTER (target IS NULL) "
    "+ count(*) FILTER (close IS NULL) + count(*) FILTER (label IS NULL) FROM gappy) "
    "+ count(*) FILTER (event_type = 'click') AS missing, "
    "count(*) FILTER (event_type = 'view') AS not_finite FROM events UNION ALL SELECT 'clean', 0, 0",
    "p12_sequences": f"WITH {_SEQUENCES} " + final("samples", ["bar_ts"], _SEQ_REAL, _SEQ_WHOLE),
    "p12_last_sequence": f"WITH {_SEQUENCES} "
    + final("samples", ["bar_ts"], _SEQ_REAL, _SEQ_WHOLE)
    + " WHERE decoder_length = 12 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY samples.bar_ts DESC) = 1",
    "p13_target_scale": f"WITH {_TARGETS}, s AS (SELECT symbol, bar_ts, "
    "avg(target) OVER (PARTITION BY symbol) AS target_center, "
    "stddev_samp(target) OVER (PARTITION BY symbol) AS target_scale FROM targets) "
    + final("s", ["bar_ts"], ["target_center", "target_scale"], ["symbol"]),
    "p14_training_table": f"WITH {_TARGETS} " + final("targets", ["bar_ts"], ["target"], ["symbol", "time_idx"]),
    "o01_time_sort": f"WITH {HOURLY_BARS}, p AS (SELECT *, row_number() OVER (ORDER BY symbol, bar_ts) - 1 AS position FROM bars) "
    + final("p", ["bar_ts"], ["close"], ["symbol", "position"]),
    "o02_score_sort": f"WITH {_information()}, p AS (SELECT *, "
    "row_number() OVER (ORDER BY importance_score DESC, feature) - 1 AS position FROM scores) "
    + final("p", [], ["importance_score"], ["feature", "role", "position"]),
    "o03_top_per_role": f"WITH {_information()} "
    + final("ranked", [], ["importance_score"], ["feature", "role", "rank"])
    + " WHERE rank <= 3",
    "o04_top_features": f"WITH {_information()} "
    + final("ranked", [], ["importance_score"], ["feature", "role"])
    + " WHERE rank <= 2",
}
ORACLES["j11_aligned_rows"] = (
    f"WITH {_TARGETS}, a AS (SELECT * FROM targets WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in RANKED)
    + ") "
    + final("a", ["bar_ts"], ["target", *RANKED], ["symbol"])
)


def _scaled_and_filled(c: str) -> str:
    """The column scaled by the training part's quartiles, then filled forward, then by the training median."""
    middle = f"(SELECT quantile_cont({c}, 0.5) FROM t WHERE is_train)"
    width = f"(SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM t WHERE is_train)"
    scaled = f"({c} - {middle}) / CASE WHEN {width} = 0 THEN 1 ELSE {width} END"
    kept = f"last_value({scaled} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS UNBOUNDED PRECEDING)"
    return f"coalesce({kept}, 0) AS {c}"


ORACLES["p14_training_features"] = (
    f"WITH {_TARGETS}, t AS (SELECT symbol, bar_ts, target, momentum_5, "
    "lag(close) OVER (PARTITION BY symbol ORDER BY bar_ts) AS close_lag_1, close * volume AS close_x_volume, "
    "row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) <= floor(0.8 * count(*) OVER (PARTITION BY symbol)) AS is_train "
    "FROM targets), "
    f"f AS (SELECT symbol, bar_ts, is_train, target, {', '.join(map(_scaled_and_filled, ('momentum_5', 'close_lag_1', 'close_x_volume')))} FROM t) "
    + final("f", ["bar_ts"], ["target", "momentum_5", "close_lag_1", "close_x_volume"], ["symbol", "is_train"])
)
