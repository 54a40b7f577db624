"""Queries and SQL for the window building blocks, on ticks of many users.

`x` is the tick value, missing on error events.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import rolling as R
from tickloom.functions.numeric import flag as int_flag
from tickloom.functions.numeric import ratio
from tickloom.functions.smoothing import weighted_means
from tickloom.operators.recipe import Level, Recipe, add_features
from tickloom.operators.series import Series, plan_series
from tickloom.plans import shapes
from tickloom.plans.present import present
from tickloom.plans.sql_parts import div, final, flag, roll, roll_quantile, windows

KEEP = ["user_id", "event_id"]
SERIES = Series(("user_id",), "ts", ("event_id",))


def _ticks(spark, folder):
    events = shapes.table(spark, folder, "events")
    x = F.when(F.col("event_type") != "error", F.col("value"))
    return events.select("user_id", "ts", "event_id", "value", x.alias("x"))


def _query(make, digits: int = 6, series: Series = SERIES):
    def query(spark, folder):
        return present(add_features(_ticks(spark, folder), series, [make], keep=KEEP), digits)

    return query


def _recipe(columns, back=0, ahead=0, number=False, filled=None):
    """A one-level recipe from a function of the frames."""

    def make(f):
        out = columns(f)
        return Recipe([*out], [Level(add=out)], back, ahead, number, filled(f) if filled else {})

    return make


lags = _recipe(
    lambda f: {
        "lag_3": f.lag("x", 3),
        "lead_2": f.lead("x", 2),
        "diff_1": F.col("x") - f.lag("x"),
    },
    back=3,
    ahead=2,
)
changes = _recipe(
    lambda f: {f"change_{k}": ratio(F.col("__x"), f.lag("__x", k)) - 1 for k in (1, 5)},
    back=5,
    filled=lambda f: {"__x": F.col("x")},
)
statistics = _recipe(
    lambda f: {
        f"{name}_{n}": fn(f, "x", n)
        for n in (3, 7)
        for name, fn in (
            ("mean", R.mean),
            ("sum", R.total),
            ("std", R.deviation),
            ("min", R.lowest),
            ("max", R.highest),
        )
    },
    back=7,
)
quantiles = _recipe(
    lambda f: {
        "q20_20": R.quantile(f, "value", 0.2, 20),
        "q25_7": R.quantile(f, "x", 0.25, 7),
        "q75_7": R.quantile(f, "x", 0.75, 7),
    },
    back=20,
)
scores = _recipe(
    lambda f: {
        f"zscore_{n}": (F.col("x") - R.mean(f, "x", n)) / (R.deviation(f, "x", n) + 1e-10)
        for n in (3, 7)
    },
    back=7,
)
trend = _recipe(
    lambda f: {"trend_10": R.trend_correlation(f, "value", "__pos", 10)}, back=10, number=True
)
spread = _recipe(lambda f: {"mad_20": R.absolute_deviation(f, "value", 20)}, back=20)
extrema = _recipe(
    lambda f: {
        f"{name}_{k}": int_flag(
            F.when(F.count("value").over(f.around(k)) == 2 * k + 1, fn("value").over(f.around(k)))
            == F.col("value")
        )
        for k in (2, 5)
        for name, fn in (("top", F.max), ("bottom", F.min))
    },
    back=5,
    ahead=5,
)


def running_sum(f):
    return Recipe(["running"], [Level(cumulate={"running": F.col("x")})])


def smoothed(f):
    levels, back = weighted_means(f, {"ewm_3": ("x", 3), "ewm_10": ("x", 10)})
    return Recipe(["ewm_3", "ewm_10"], levels, back)


def since_error(f):
    at = F.when(F.col("x").isNull(), F.col("__pos"))
    since = F.col("__pos") - F.coalesce(F.col("__at"), F.lit(0))
    return Recipe(
        ["rows_since"], [Level(carry={"__at": at}), Level(add={"rows_since": since})], number=True
    )


def nested(f):
    return Recipe(
        ["std_ratio", "wide"],
        [
            Level(add={"__std": R.deviation(f, "value", 10)}),
            Level(
                add={
                    "std_ratio": ratio(F.col("__std"), R.mean(f, "__std", 15)),
                    "wide": int_flag(F.col("__std") > R.quantile(f, "__std", 0.75, 15)),
                }
            ),
        ],
        back=25,
    )


def row_numbers(f):
    return Recipe(["row_index"], [Level(add={"row_index": F.col("__pos")})], number=True)


def _filled(spark, folder):
    df = _ticks(spark, folder)
    layout = plan_series(df, SERIES)
    both = (
        layout.open(df)
        .carry({"forward": F.col("x")})
        .carry_back({"__back": F.col("x")})
        .add({"filled": F.coalesce(F.col("forward"), F.col("__back"))})
        .close("__back")
    )
    return present(both.select(*KEEP, "forward", "filled"))


def _hot_day(spark, folder):
    """All ticks as one series of one day, cut by rows into chunks of 2,000."""
    at = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) % F.lit(86_400_000_000)).cast("timestamp_ntz")
    df = shapes.user_ticks(spark, folder).select(F.lit("all").alias("line"), at.alias("ts"), "event_id", "value")
    series = Series(("line",), "ts", ("event_id",), chunk_rows=2_000)

    def stats(f):
        out = {"mean_50": R.mean(f, "value", 50), "next_7": f.lead("value", 7)}
        return Recipe([*out], [Level(add=out)], back=50, ahead=7)

    return present(add_features(df, series, [stats], keep=["event_id"]))


def _one_series(spark, folder):
    """All ticks as one long series, cut into chunks of 2,000 rows."""
    df = _ticks(spark, folder).withColumn("line", F.lit("all"))
    series = Series(("line",), "ts", ("event_id",), bucket="hour", chunk_rows=2_000)

    def stats(f):
        return Recipe(
            ["mean_50", "mad_20", "top_5", "running", "row_index", "std_ratio"],
            [
                Level(
                    add={
                        "mean_50": R.mean(f, "value", 50),
                        "mad_20": R.absolute_deviation(f, "value", 20),
                        "top_5": int_flag(
                            F.when(
                                F.count("value").over(f.around(5)) == 11,
                                F.max("value").over(f.around(5)),
                            )
                            == F.col("value")
                        ),
                        "__std": R.deviation(f, "value", 10),
                        "row_index": F.col("__pos"),
                    },
                    cumulate={"running": F.col("x")},
                ),
                Level(add={"std_ratio": ratio(F.col("__std"), R.mean(f, "__std", 15))}),
            ],
            back=50,
            ahead=5,
            number=True,
        )

    def last_seen(f):
        return Recipe(["last_x"], [Level(carry={"last_x": F.col("x")})])

    def weighted(f):
        made, back = weighted_means(f, {"ewm_10": ("x", 10)})
        return Recipe(["ewm_10"], made, back)

    df = add_features(df, series, [stats, last_seen, weighted], keep=["event_id"])
    return present(df, coarse={"running": 4})


QUERIES = {
    "w01_lag_lead_diff": _query(lags),
    "w02_percent_change": _query(changes),
    "w03_rolling_statistics": _query(statistics),
    "w04_rolling_quantiles": _query(quantiles),
    "w05_rolling_zscore": _query(scores),
    "w06_running_sum": _query(running_sum),
    "w07_weighted_means": _query(smoothed),
    "w08_rolling_trend": _query(trend),
    "w09_rolling_abs_deviation": _query(spread),
    "w10_centred_extrema": _query(extrema),
    "w11_rows_since": _query(since_error),
    "w12_fill_both_ways": _filled,
    "w13_row_index": _query(row_numbers),
    "w14_nested_windows": _query(nested),
    "w15_one_long_series": _one_series,
    "w16_one_hot_day": _hot_day,
}

TICKS = """
ticks AS (
  SELECT user_id, ts, event_id, value, CASE WHEN event_type <> 'error' THEN value END AS x
  FROM events)"""


def _sql(steps, sizes, reals, whole=(), part="user_id", coarse=None, keys=("user_id", "event_id")):
    ctes = [TICKS]
    for name, columns, source in steps:
        clause = windows(part, "ts, event_id", sizes)
        ctes.append(f"{name} AS (SELECT *, {columns} FROM {source} {clause})")
    return f"WITH {', '.join(ctes)} " + final(
        steps[-1][0], [], reals, [*keys, *whole], coarse=coarse
    )


def _held_mean(held: str, span: int) -> str:
    d = 1 - 2 / (span + 1)
    low = f"list_sum(list_transform({held}, lambda v, i: CASE WHEN v IS NULL THEN 0 ELSE pow({d!r}, len({held}) - i) END))"
    top = f"list_sum(list_transform({held}, lambda v, i: v * pow({d!r}, len({held}) - i)))"
    return f"{top} / nullif({low}, 0)"


def _extreme(name: str, fn: str, k: int, part: str = "user_id") -> str:
    frame = (
        f"OVER (PARTITION BY {part} ORDER BY ts, event_id "
        f"ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)"
    )
    return f"{flag(f'count(value) {frame} = {2 * k + 1} AND {fn}(value) {frame} = value')} AS {name}_{k}"


_FILL = "last_value(x IGNORE NULLS) OVER c"
ORACLES = {
    "w01_lag_lead_diff": _sql(
        [("a", "lag(x, 3) OVER e AS lag_3, lead(x, 2) OVER e AS lead_2, x - lag(x) OVER e AS diff_1", "ticks")],
        (),
        ["lag_3", "lead_2", "diff_1"],
    ),
    "w02_percent_change": _sql(
        [
            ("a", f"{_FILL} AS f", "ticks"),
            ("b", ", ".join(f"{div('f', f'lag(f, {k}) OVER e')} - 1 AS change_{k}" for k in (1, 5)), "a"),
        ],
        (),
        ["change_1", "change_5"],
    ),
    "w03_rolling_statistics": _sql(
        [
            (
                "a",
                ", ".join(
                    f"{roll(fn, 'x', n)} AS {name}_{n}"
                    for n in (3, 7)
                    for name, fn in (
                        ("mean", "avg"),
                        ("sum", "sum"),
                        ("std", "stddev_samp"),
                        ("min", "min"),
                        ("max", "max"),
                    )
                ),
                "ticks",
            )
        ],
        (3, 7),
        [f"{s}_{n}" for n in (3, 7) for s in ("mean", "sum", "std", "min", "max")],
    ),
    "w04_rolling_quantiles": _sql(
        [
            (
                "a",
                f"{roll_quantile('value', 0.2, 20)} AS q20_20, {roll_quantile('x', 0.25, 7)} AS q25_7, "
                f"{roll_quantile('x', 0.75, 7)} AS q75_7",
                "ticks",
            )
        ],
        (7, 20),
        ["q20_20", "q25_7", "q75_7"],
    ),
    "w05_rolling_zscore": _sql(
        [
            (
                "a",
                ", ".join(
                    f"(x - {roll('avg', 'x', n)}) / ({roll('stddev_samp', 'x', n)} + 1e-10) AS zscore_{n}"
                    for n in (3, 7)
                ),
                "ticks",
            )
        ],
        (3, 7),
        ["zscore_3", "zscore_7"],
    ),
    "w06_running_sum": _sql(
        [("a", "CASE WHEN x IS NOT NULL THEN sum(x) OVER c END AS running", "ticks")], (), ["running"]
    ),
    "w07_weighted_means": _sql(
        [
            ("a", "list(x) OVER c AS h", "ticks"),
            ("b", f"{_held_mean('h', 3)} AS ewm_3, {_held_mean('h', 10)} AS ewm_10", "a"),
        ],
        (),
        ["ewm_3", "ewm_10"],
    ),
    "w08_rolling_trend": _sql(
        [
            ("a", "row_number() OVER e AS i", "ticks"),
            (
                "b",
                "CASE WHEN count(value) OVER w10 = 10 AND max(value) OVER w10 > min(value) OVER w10 "
                "THEN corr(value, i) OVER w10 END AS trend_10",
                "a",
            ),
        ],
        (10,),
        ["trend_10"],
    ),
    "w09_rolling_abs_deviation": _sql(
        [
            ("a", f"{roll('avg', 'value', 20)} AS m, list(value) OVER w20 AS h", "ticks"),
            (
                "b",
                "CASE WHEN m IS NOT NULL THEN list_sum(list_transform(h, lambda v: abs(v - m))) / 20 END AS mad_20",
                "a",
            ),
        ],
        (20,),
        ["mad_20"],
    ),
    "w10_centred_extrema": _sql(
        [
            (
                "a",
                ", ".join(
                    _extreme(name, fn, k) for k in (2, 5) for name, fn in (("top", "max"), ("bottom", "min"))
                ),
                "ticks",
            )
        ],
        (),
        [],
        ["top_2", "top_5", "bottom_2", "bottom_5"],
    ),
    "w11_rows_since": _sql(
        [
            ("a", "count(CASE WHEN x IS NULL THEN 1 END) OVER c AS g", "ticks"),
            ("b", "row_number() OVER (PARTITION BY user_id, g ORDER BY ts, event_id) - 1 AS rows_since", "a"),
        ],
        (),
        [],
        ["rows_since"],
    ),
    "w12_fill_both_ways": _sql(
        [
            ("a", f"{_FILL} AS forward", "ticks"),
            (
                "b",
                "coalesce(forward, first_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id "
                "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled",
                "a",
            ),
        ],
        (),
        ["forward", "filled"],
    ),
    "w13_row_index": _sql([("a", "row_number() OVER e - 1 AS row_index", "ticks")], (), [], ["row_index"]),
    "w14_nested_windows": _sql(
        [
            ("a", f"{roll('stddev_samp', 'value', 10)} AS s", "ticks"),
            (
                "b",
                f"{div('s', roll('avg', 's', 15))} AS std_ratio, "
                f"{flag('s > ' + roll_quantile('s', 0.75, 15))} AS wide",
                "a",
            ),
        ],
        (10, 15),
        ["std_ratio"],
        ["wide"],
    ),
    "w15_one_long_series": _sql(
        [
            ("z", "'all' AS line", "ticks"),
            (
                "a",
                f"{roll('avg', 'value', 50)} AS mean_50, {roll('avg', 'value', 20)} AS m, "
                f"list(value) OVER w20 AS h, {_extreme('top', 'max', 5, 'line')}, "
                f"CASE WHEN x IS NOT NULL THEN sum(x) OVER c END AS running, "
                f"row_number() OVER e - 1 AS row_index, {roll('stddev_samp', 'value', 10)} AS s, "
                f"{_FILL} AS last_x, list(x) OVER w400 AS k",
                "z",
            ),
            (
                "b",
                "CASE WHEN m IS NOT NULL THEN list_sum(list_transform(h, lambda v: abs(v - m))) / 20 END AS mad_20, "
                f"{div('s', roll('avg', 's', 15))} AS std_ratio, {_held_mean('k', 10)} AS ewm_10",
                "a",
            ),
        ],
        (10, 15, 20, 50, 400),
        ["mean_50", "mad_20", "running", "std_ratio", "last_x", "ewm_10"],
        ["top_5", "row_index"],
        part="line",
        coarse={"running": 4},
        keys=("event_id",),
    ),
}
ORACLES["w16_one_hot_day"] = (
    "WITH t AS (SELECT event_id, value, ts - date_trunc('day', ts) AS clock FROM events), "
    "v AS (SELECT event_id, CASE WHEN count(value) OVER w = 50 THEN avg(value) OVER w END AS mean_50, "
    "lead(value, 7) OVER o AS next_7 FROM t WINDOW o AS (ORDER BY clock, event_id), "
    "w AS (ORDER BY clock, event_id ROWS 49 PRECEDING)) "
    + final("v", [], ["mean_50", "next_7"], ["event_id"])
)
