"""Daily market context: volatility index, yields, dollar, sectors.

Input is one long table (series, day, close). Each group of features is a window
pass over its series and an aggregation by day; `daily_context` makes all groups
in one pass.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import rolling as R
from tickloom.functions.numeric import flag, ratio
from tickloom.operators.calendar import BROADCAST_DAYS, day_span, day_table
from tickloom.operators.recipe import Level, Recipe, add_features
from tickloom.operators.series import Frames, Series
from tickloom.operators.statistics import written_once


def daily_series(daily: DataFrame, span: tuple[dt.date, dt.date] | None = None) -> Series:
    """One row per series and day, so the date range bounds every series."""
    start, end = span or day_span(daily, "day")
    return Series(("series",), "day", bucket="year", max_rows=(end - start).days + 1)


# The vendor symbols of each role.
PROXIES = {"VIX": "VIX", "DXY": "UUP", "TNX": "TNX", "FVX": "FVX"}
SECTOR_SYMBOLS = ["XLK", "XLF", "XLE", "XLV", "XLI", "XLU", "XLRE", "XLP", "XLY", "XLB"]


def _changes(f: Frames, periods: Sequence[int]) -> dict[str, Column]:
    return {f"__pct_{k}": ratio(F.col("__close"), f.lag("__close", k)) - 1 for k in periods}


def _means(f: Frames, sizes: Sequence[int]) -> dict[str, Column]:
    return {f"__ma_{n}": R.mean(f, "close", n) for n in sizes}


def _gap(n: int) -> Column:
    return (ratio(F.col("close"), F.col(f"__ma_{n}")) - 1) * 100


def volatility_index(f: Frames, name: str = "vix") -> Recipe:
    close = F.col("close")
    before = f.lag("__close")
    spike = F.when(before == 0, F.col("__close") > 0).otherwise(F.col("__pct_1") > 0.1)
    out = {
        name: close,
        f"{name}_change": F.col("__pct_1") * 100,
        f"{name}_ma_5": F.col("__ma_5"),
        f"{name}_ma_20": F.col("__ma_20"),
        f"{name}_to_ma5": _gap(5),
        f"{name}_to_ma20": _gap(20),
        f"{name}_volatility": R.deviation(f, "close", 10),
        f"{name}_low_regime": flag(close < 20),
        f"{name}_high_regime": flag(close > 30),
        f"{name}_spike": flag(spike),
        f"{name}_momentum": F.col("__diff_5"),
        f"{name}_acceleration": F.col("__diff_5") - f.lag("__diff_5", 3),
    }
    first = {**_changes(f, [1]), **_means(f, [5, 20]), "__diff_5": close - f.lag("close", 5)}
    return Recipe(
        [*out], [Level(add=first), Level(add=out)], back=20, filled={"__close": close}
    )


def yields(f: Frames) -> Recipe:
    """Level, difference and two means; named per tenor when made wide."""
    out = {
        "yield": F.col("close"),
        "yield_change": F.col("close") - f.lag("close"),
        "yield_ma_5": R.mean(f, "close", 5),
        "yield_ma_20": R.mean(f, "close", 20),
    }
    return Recipe([*out], [Level(add=out)], back=20)


def dollar_index(f: Frames, name: str = "dxy") -> Recipe:
    close = F.col("close")
    out = {
        name: close,
        f"{name}_change": F.col("__pct_1") * 100,
        **{f"{name}_ma_{n}": F.col(f"__ma_{n}") for n in (5, 20, 50)},
        f"{name}_to_ma5": _gap(5),
        f"{name}_to_ma20": _gap(20),
        f"{name}_strong": flag(close > F.col("__ma_20")),
        f"{name}_momentum": close - f.lag("close", 5),
        f"{name}_volatility": R.deviation(f, "close", 10),
    }
    first = {**_changes(f, [1]), **_means(f, [5, 20, 50])}
    return Recipe(
        [*out], [Level(add=first), Level(add=out)], back=50, filled={"__close": close}
    )


def sector_moves(f: Frames) -> Recipe:
    out = {
        "return": F.col("__pct_1") * 100,
        "ma_5": F.col("__ma_5"),
        "ma_20": F.col("__ma_20"),
        "to_ma20": _gap(20),
        "momentum_5": F.col("__pct_5") * 100,
        "momentum_20": F.col("__pct_20") * 100,
    }
    first = {**_changes(f, [1, 5, 20]), **_means(f, [5, 20])}
    return Recipe(
        [*out],
        [Level(add=first), Level(add=out)],
        back=21,
        filled={"__close": F.col("close")},
    )


def _of(daily: DataFrame, *names: str) -> DataFrame:
    return daily.where(F.col("series").isin(*names))


def volatility_features(
    daily: DataFrame, source: str = "VIX", series: Series | None = None
) -> DataFrame:
    return add_features(_of(daily, source), series or daily_series(daily), [volatility_index], keep=["day"])


def dollar_features(
    daily: DataFrame, source: str = "DXY", series: Series | None = None
) -> DataFrame:
    return add_features(_of(daily, source), series or daily_series(daily), [dollar_index], keep=["day"])


def _wide(long: DataFrame, names: dict[str, str], columns: Sequence[str], name_of) -> DataFrame:
    """One row per day, one column per (series, column); a day on which any
    series has a row is kept."""
    picked = [
        F.max(F.when(F.col("series") == s, F.col(c))).alias(name_of(label, c))
        for s, label in names.items()
        for c in columns
    ]
    return long.groupBy("day").agg(*picked)


def yield_features(
    daily: DataFrame, short: str = "FVX", long: str = "TNX", series: Series | None = None
) -> DataFrame:
    """Both tenors on their own days."""
    each = add_features(_of(daily, short, long), series or daily_series(daily), [yields], keep=["series", "day"])
    columns = ["yield", "yield_change", "yield_ma_5", "yield_ma_20"]
    return _wide(
        each,
        {short: "2y", long: "10y"},
        columns,
        lambda label, c: c.replace("yield", f"yield_{label}"),
    )


def curve(f: Frames) -> Recipe:
    spread = F.col("yield_spread")
    move = spread - f.lag("yield_spread")
    out = {
        "yield_spread_change": move,
        "yield_spread_ma_5": R.mean(f, "yield_spread", 5),
        "curve_steepening": flag(move > 0),
        "curve_flattening": flag(move < 0),
        "inverted_curve": flag(spread < 0),
        "yield_ratio": ratio(F.col("__long"), F.col("__short") + 0.01),
    }
    return Recipe(["yield_spread", *out], [Level(add=out)], back=5)


def curve_features(
    daily: DataFrame, short: str = "FVX", long: str = "TNX", series: Series | None = None
) -> DataFrame:
    """Spread features on the days both tenors have."""
    both = (
        _of(daily, short, long)
        .groupBy("day")
        .agg(
            F.max(F.when(F.col("series") == short, F.col("close"))).alias("__short"),
            F.max(F.when(F.col("series") == long, F.col("close"))).alias("__long"),
        )
        .where(F.col("__short").isNotNull() & F.col("__long").isNotNull())
        .select(
            F.lit("curve").alias("series"),
            "day",
            "__short",
            "__long",
            (F.col("__long") - F.col("__short")).alias("yield_spread"),
        )
    )
    return add_features(both, series or daily_series(daily), [curve], keep=["day"])


def treasury_features(
    daily: DataFrame, short: str = "FVX", long: str = "TNX", series: Series | None = None
) -> DataFrame:
    series = series or daily_series(daily)
    return yield_features(daily, short, long, series).join(
        curve_features(daily, short, long, series), "day", "full_outer"
    )


def sector_features(
    daily: DataFrame,
    sectors: Sequence[str] = tuple(SECTOR_SYMBOLS),
    series: Series | None = None,
) -> DataFrame:
    """Six columns per sector and three across sectors, by day."""
    each = add_features(_of(daily, *sectors), series or daily_series(daily), [sector_moves], keep=["series", "day"])
    columns = ["return", "ma_5", "ma_20", "to_ma20", "momentum_5", "momentum_20"]
    picked = [
        F.max(F.when(F.col("series") == s, F.col(c))).alias(f"{s}_{c}")
        for s in sectors
        for c in columns
    ]
    across = [
        F.stddev_samp("return").alias("sector_dispersion"),
        (F.max("return") - F.min("return")).alias("sector_range"),
        F.stddev_samp("momentum_5").alias("sector_momentum_dispersion"),
    ]
    return each.groupBy("day").agg(*picked, *(across if len(sectors) > 1 else []))


def _moves_of_all(f: Frames) -> Recipe:
    """What any of the groups needs of its series, in one window pass."""
    first = {
        **_changes(f, [1, 5, 20]),
        **_means(f, [5, 20, 50]),
        "__diff_1": F.col("close") - f.lag("close"),
        "__diff_5": F.col("close") - f.lag("close", 5),
        "__std_10": R.deviation(f, "close", 10),
        "__before": f.lag("__close"),
    }
    second = {"__acceleration": F.col("__diff_5") - f.lag("__diff_5", 3)}
    outputs = ["__close", *first, *second]
    return Recipe(outputs, [Level(add=first), Level(add=second)], back=50, filled={"__close": F.col("close")})


def _group_columns() -> dict[str, dict[str, Column]]:
    """Columns of each group from `_moves_of_all`, on the rows of its series."""
    close, change = F.col("close"), F.col("__pct_1") * 100
    spike = F.when(F.col("__before") == 0, F.col("__close") > 0).otherwise(F.col("__pct_1") > 0.1)
    means = {n: F.col(f"__ma_{n}") for n in (5, 20, 50)}
    volatility = {
        "vix": close, "vix_change": change, "vix_ma_5": means[5], "vix_ma_20": means[20],
        "vix_to_ma5": _gap(5), "vix_to_ma20": _gap(20), "vix_volatility": F.col("__std_10"),
        "vix_low_regime": flag(close < 20), "vix_high_regime": flag(close > 30), "vix_spike": flag(spike),
        "vix_momentum": F.col("__diff_5"), "vix_acceleration": F.col("__acceleration"),
    }
    dollar = {
        "dxy": close, "dxy_change": change, "dxy_ma_5": means[5], "dxy_ma_20": means[20], "dxy_ma_50": means[50],
        "dxy_to_ma5": _gap(5), "dxy_to_ma20": _gap(20), "dxy_strong": flag(close > means[20]),
        "dxy_momentum": F.col("__diff_5"), "dxy_volatility": F.col("__std_10"),
    }
    bond = {"yield": close, "yield_change": F.col("__diff_1"), "yield_ma_5": means[5], "yield_ma_20": means[20]}
    move = F.col("__diff_1")
    curve = {
        "yield_spread": close, "yield_spread_change": move, "yield_spread_ma_5": means[5],
        "curve_steepening": flag(move > 0), "curve_flattening": flag(move < 0), "inverted_curve": flag(close < 0),
        "yield_ratio": F.col("ratio"),
    }
    sector = {
        "return": change, "ma_5": means[5], "ma_20": means[20], "to_ma20": _gap(20),
        "momentum_5": F.col("__pct_5") * 100, "momentum_20": F.col("__pct_20") * 100,
    }
    return {"volatility": volatility, "dollar": dollar, "bond": bond, "curve": curve, "sector": sector}


CURVE = "__curve"


def daily_context(
    daily: DataFrame,
    sectors: Sequence[str] = tuple(SECTOR_SYMBOLS),
    series: Series | None = None,
    symbols: dict[str, str] | None = None,
) -> DataFrame:
    """day, and a struct per group of `cross_asset_tables`, missing on days without a row of the group.

    The closes of a day are brought together once, which gives the yield spread as
    one more series; all series take one window pass, and one aggregation by day
    makes the columns of all groups.
    """
    names = {"VIX": "VIX", "DXY": "DXY", "FVX": "FVX", "TNX": "TNX"} | (symbols or {})
    short, long = names["FVX"], names["TNX"]
    used = list(dict.fromkeys([*names.values(), *sectors]))
    # one close per series and day; a day's closes fit one row
    by_day = _of(daily, *used).groupBy("day").agg(
        F.collect_list(F.struct("series", "close")).alias("rows"),
        *[F.max(F.when(F.col("series") == s, F.col("close"))).alias(c) for s, c in ((short, "__short"), (long, "__long"))],
    )
    spread = F.struct(
        F.lit(CURVE).alias("series"), (F.col("__long") - F.col("__short")).alias("close"), ratio(F.col("__long"), F.col("__short") + 0.01).alias("ratio")
    )
    rows = F.transform("rows", lambda r: F.struct(r["series"].alias("series"), r["close"].alias("close"), F.lit(None).cast("double").alias("ratio")))
    with_curve = F.when(F.col("__short").isNotNull() & F.col("__long").isNotNull(), F.array_append(rows, spread)).otherwise(rows)
    each = by_day.select("day", F.explode(with_curve).alias("r")).select("r.series", "day", "r.close", "r.ratio")
    each = add_features(each, series or daily_series(daily), [_moves_of_all])

    groups = _group_columns()

    def of(symbol: str, column: Column) -> Column:
        return F.max(F.when(F.col("series") == symbol, column))

    def any_of(*wanted: str) -> Column:
        return F.count_if(F.col("series").isin(*wanted)) > 0

    def packed(columns: dict[str, Column], present: Column, name: str) -> Column:
        return F.when(present, F.struct(*[c.alias(n) for n, c in columns.items()])).alias(name)

    volatility = {n: of(names["VIX"], c) for n, c in groups["volatility"].items()}
    dollar = {n: of(names["DXY"], c) for n, c in groups["dollar"].items()}
    treasury = {
        n.replace("yield", f"yield_{label}"): of(s, c) for s, label in ((short, "2y"), (long, "10y")) for n, c in groups["bond"].items()
    }
    treasury |= {n: of(CURVE, c) for n, c in groups["curve"].items()}
    sector = {f"{s}_{n}": of(s, c) for s in sectors for n, c in groups["sector"].items()}
    if len(sectors) > 1:
        own = F.col("series").isin(*sectors)
        returns, momentum = (F.when(own, groups["sector"][n]) for n in ("return", "momentum_5"))
        sector |= {
            "sector_dispersion": F.stddev_samp(returns),
            "sector_range": F.max(returns) - F.min(returns),
            "sector_momentum_dispersion": F.stddev_samp(momentum),
        }
    return each.groupBy("day").agg(
        packed(volatility, any_of(names["VIX"]), "volatility"),
        packed(treasury, any_of(short, long), "treasury"),
        packed(dollar, any_of(names["DXY"]), "dollar"),
        packed(sector, any_of(*sectors), "sectors"),
    )


def cross_asset_tables(
    daily: DataFrame, sectors: Sequence[str] = tuple(SECTOR_SYMBOLS), series: Series | None = None
) -> list[DataFrame]:
    series = series or daily_series(daily)
    return [
        volatility_features(daily, series=series),
        treasury_features(daily, series=series),
        dollar_features(daily, series=series),
        sector_features(daily, sectors, series),
    ]


def with_daily(
    bars: DataFrame,
    tables: Sequence[DataFrame],
    time: str = "bar_ts",
    availability_lag: int = 1,
    start: dt.date | None = None,
) -> DataFrame:
    """Bars with the latest row of each daily table that was known by then.

    A daily close becomes visible `availability_lag` days after its day; 0
    shows it from the midnight that starts the day. Every table is first
    filled onto all days, so the bars themselves take one equality join.
    `start` is a day not after the first of the tables, if already known.
    """
    packed = [t.select("day", F.struct(*[c for c in t.columns if c != "day"]).alias(f"__row_{i}")) for i, t in enumerate(tables)]
    return _with_filled(bars, packed, time, availability_lag, start)


def _with_filled(
    bars: DataFrame, packed: Sequence[DataFrame], time: str, availability_lag: int, start: dt.date | None
) -> DataFrame:
    """Bars with the fields of the latest known struct of each column of (day, struct...) tables."""
    spark = bars.sparkSession
    _, end = day_span(bars, time)
    if start is None:
        starts = [t.agg(F.min("day")).first()[0] for t in packed]
        start = min([s for s in starts if s is not None], default=end)
    last = max(end, start)
    # days, not rows, bound this window: one row per calendar day
    upto = Window.partitionBy(F.lit(0)).orderBy("day")
    upto = upto.rowsBetween(Window.unboundedPreceding, 0)
    grid = day_table(spark, start, last)
    for t in packed:
        grid = grid.join(t, "day", "left")
    structs = [f for t in packed for f in t.schema.fields if f.name != "day"]
    filled = grid.select(
        F.date_add("day", availability_lag).alias("__day"),
        *[F.last(f.name, ignorenulls=True).over(upto).alias(f.name) for f in structs],
    ).select("__day", *[f"{f.name}.*" for f in structs])
    days = (last - start).days + 1
    width = sum(len(f.dataType.fields) for f in structs)
    small = days <= BROADCAST_DAYS and days * width * 8 <= 64 << 20
    filled = F.broadcast(filled) if small else filled
    return (
        bars.withColumn("__day", F.to_date(time)).join(filled, "__day", "left").drop("__day")
    )


def cross_asset_features(
    bars: DataFrame,
    daily: DataFrame,
    sectors: Sequence[str] = tuple(SECTOR_SYMBOLS),
    time: str = "bar_ts",
    availability_lag: int = 1,
) -> DataFrame:
    daily = written_once(daily.select("series", "day", "close"))  # for the span and the one pass
    span = day_span(daily, "day")
    context = daily_context(daily, sectors, daily_series(daily, span))
    return _with_filled(bars, [context], time, availability_lag, span[0])
