"""Training tables: roles, lags, interactions, encoding, selection, scaling,
targets, gap filling, cleaning and sequence samples."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import finite
from tickloom.operators import statistics as S
from tickloom.operators.recipe import Level, Recipe, add_features
from tickloom.operators.series import Frames, Series, SeriesLayout, plan_series
from tickloom.session import materialise

# Name patterns that decide the role of a column.
STATIC_PATTERNS = (
    "sector", "market_cap", "beta", "industry", "exchange", "currency", "country",
)
KNOWN_PATTERNS = (
    "fed_meeting", "earnings", "holiday", "expiration", "employment_report",
    "cpi_release", "gdp_release", "jobless_claims", "market_holiday", "half_day_trading",
    "options_expiration", "days_to_", "days_since_", "hour_sin", "hour_cos", "dow_sin",
    "dow_cos", "dom_sin", "dom_cos", "month_sin", "month_cos", "market_open", "pre_market",
    "after_hours",
)
UNLAGGED_PATTERNS = ("_lag_", "regime", "_sin", "_cos", "category")
CATEGORY_PATTERNS = ("category", "regime", "sector", "industry", "exchange")
PRICE_WORDS = ("price", "close", "open", "high", "low")
VOLATILITY_WORDS = ("volatility", "vix", "atr", "bb_width")
OSCILLATOR_PAIR = ("rsi_14", "macd_histogram")
#: Products that a training plan offers unless it names others: three prices by two
#: volumes and three sentiments by two volatilities.
USUAL_PAIRS = (
    ("open", "volume"), ("open", "volume_ratio_5"),
    ("high", "volume"), ("high", "volume_ratio_5"),
    ("low", "volume"), ("low", "volume_ratio_5"),
    ("sent_mean", "volatility_5"), ("sent_mean", "volatility_10"),
    ("sent_max_abs", "volatility_5"), ("sent_max_abs", "volatility_10"),
    ("sent_mean_ma_3", "volatility_5"), ("sent_mean_ma_3", "volatility_10"),
    OSCILLATOR_PAIR,
)

UNKNOWN = "Unknown"
#: A label dictionary of at most this many values is applied as a constant map.
MAPPED_VALUES = 200
#: A lookup table with at most this many rows is broadcast.
BROADCAST_ROWS = 100_000

STATIC_DEFAULTS = {
    "sector": UNKNOWN,
    "industry": UNKNOWN,
    "market_cap_category": UNKNOWN,
    "exchange": UNKNOWN,
    "beta_category": UNKNOWN,
    "dividend_paying": 0,
    "sp500_member": 0,
    "country": UNKNOWN,
}


def _has(name: str, words: Sequence[str]) -> bool:
    return any(w in name.lower() for w in words)


def _lookup(table: DataFrame) -> DataFrame:
    """Broadcast a lookup table if a bounded count shows it is small."""
    small = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(table) if small else table


# --- static covariates and roles -------------------------------------------


def with_static_info(
    df: DataFrame, info: DataFrame, key: str = "symbol", defaults: dict | None = None
) -> DataFrame:
    """Attributes of the symbol, with defaults where it is not listed. An
    attribute the table does not have at all is its default everywhere."""
    defaults = STATIC_DEFAULTS if defaults is None else defaults
    absent = {c: F.lit(v) for c, v in defaults.items() if c not in info.columns}
    held = {c: v for c, v in defaults.items() if c in info.columns}
    if not info.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} repeats in the lookup table")
    looked = df.join(_lookup(info), key, "left").fillna(held)
    return looked.withColumns(absent) if absent else looked


@dataclass
class Roles:
    static: list[str]
    known_future: list[str]
    unknown_future: list[str]
    target: list[str]

    def table(self, df: DataFrame) -> DataFrame:
        rows = [(c, role) for role, cs in vars(self).items() for c in cs]
        return df.sparkSession.createDataFrame(rows, "feature string, role string")


def assign_roles(
    df: DataFrame,
    *,
    skip: Sequence[str],
    target: str,
    threshold: float = 0.01,
    compatible: bool = False,
) -> Roles:
    """Static by name or by few distinct values, known in advance by name, else
    unknown. Roles are disjoint, a name rule before the ratio; `compatible=True`
    lets a column be static and known at once."""
    names = [c for c in df.columns if c not in skip and c != target]
    static = [c for c in names if _has(c, STATIC_PATTERNS)]
    known = [c for c in names if _has(c, KNOWN_PATTERNS)]
    open_names = [c for c in names if c not in static and (compatible or c not in known)]
    flat = S.nearly_constant(df, open_names, threshold)
    static = [c for c in names if c in static or c in flat]
    if not compatible:
        known = [c for c in known if c not in static]
    unknown = [c for c in names if c not in static and c not in known]
    return Roles(static, known, unknown, [target])


def name_roles(features: DataFrame) -> DataFrame:
    """The name rules on a (feature, ...) table."""
    lower = F.lower("feature")

    def matches(words):
        return reduce(lambda a, b: a | b, [lower.contains(w) for w in words])

    return features.withColumns(
        {
            "named_static": matches(STATIC_PATTERNS).cast("int"),
            "named_known": matches(KNOWN_PATTERNS).cast("int"),
        }
    )


# --- lags, interactions, target --------------------------------------------


def lag_candidates(names: Sequence[str]) -> list[str]:
    return [c for c in names if not _has(c, UNLAGGED_PATTERNS)]


def lag_name(column: str, period: int) -> str:
    return f"{column}_lag_{period}"


def with_lags(
    df: DataFrame,
    series: Series,
    columns: Sequence[str],
    periods: Sequence[int] = (1, 5, 10, 20),
    layout: SeriesLayout | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """`{column}_lag_{k}` for every column and period, in one projection."""
    return with_chosen_lags(df, series, [(c, k) for c in columns for k in periods], layout, keep)


def with_chosen_lags(
    df: DataFrame,
    series: Series,
    lags: Sequence[tuple[str, int]],
    layout: SeriesLayout | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """`{column}_lag_{k}` for these pairs of column and period only."""

    def make(f: Frames) -> Recipe:
        out = {lag_name(c, k): f.lag(c, k) for c, k in lags}
        return Recipe([*out], [Level(add=out)], back=max((k for _, k in lags), default=0))

    return add_features(df, series, [make], layout, keep)


def _has_word(name: str, words: Sequence[str]) -> bool:
    """Whether a word stands in the name between underscores or ends."""
    return any(f"_{w}_" in f"_{name.lower()}_" for w in words)


def interaction_pairs(names: Sequence[str]) -> list[tuple[str, str]]:
    """All pairs of a price with a volume and of a sentiment with a volatility,
    by the words of their names, each pair once; and the oscillator with the trend
    histogram. Their number grows with the square of the names: a help to write
    the list for `with_interactions`, not a default."""
    groups = [(PRICE_WORDS, ("volume",)), (("sent", "sentiment"), VOLATILITY_WORDS)]
    pairs = [
        (a, b)
        for left, right in groups
        for a in names
        for b in names
        if _has_word(a, left) and _has_word(b, right) and not _has_word(a, right) and not _has_word(b, left)
    ]
    if OSCILLATOR_PAIR[0] in names and OSCILLATOR_PAIR[1] in names:
        pairs.append(OSCILLATOR_PAIR)
    return pairs


def product_name(a: str, b: str) -> str:
    return "rsi_macd_combined" if (a, b) == OSCILLATOR_PAIR else f"{a}_x_{b}"


def with_interactions(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return df.withColumns({product_name(a, b): F.col(a) * F.col(b) for a, b in pairs}) if pairs else df


def with_target(
    df: DataFrame,
    series: Series,
    price: str = "close",
    horizon: int = 12,
    layout: SeriesLayout | None = None,
) -> DataFrame:
    """`target` is the price `horizon` rows on; rows without one are dropped and
    `time_idx` counts the others per entity. The time column stays, as the
    index hides gaps between sessions."""
    layout = layout or plan_series(df, series)
    frame = layout.open(df, ahead=horizon)
    frame = frame.add({"target": frame.frames.lead(price, horizon)})
    kept = F.col("target").isNotNull().cast("long")
    frame = frame.cumulate({"__seen": kept})
    frame = frame.add({"time_idx": F.col("__seen") - 1})
    return frame.close("__seen").where(F.col("target").isNotNull())


def aligned_rows(df: DataFrame, features: Sequence[str], target: str = "target") -> DataFrame:
    """Rows on which the target and every feature are present, so features and target have the same index."""
    return df.dropna(subset=[*features, target])


def time_split(
    df: DataFrame,
    series: Series,
    share: float = 0.8,
    layout: SeriesLayout | None = None,
) -> DataFrame:
    """Adds `is_train`: the first `share` of each entity's rows by time."""
    layout = layout or plan_series(df, series)
    frame = layout.open(df).number("__place").size("__rows")
    limit = F.floor(F.lit(share) * F.col("__rows"))
    return frame.add({"is_train": F.col("__place") < limit}).close("__place", "__rows")


# --- encoding ---------------------------------------------------------------


def categorical_columns(df: DataFrame, by_name: bool = False) -> list[str]:
    """String columns; with by_name also those whose name says category."""
    return [
        c for c, kind in df.dtypes if kind == "string" or (by_name and _has(c, CATEGORY_PATTERNS))
    ]


@dataclass
class LabelEncoder:
    """Codes 0.. in sorted order per column, as a (column, value, code) table."""

    table: DataFrame
    columns: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        """Missing and unseen values take the code of `Unknown`, or where that
        was never seen the first free code."""
        facts = self.table.groupBy("column").agg(
            F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("value") == UNKNOWN, F.col("code"))).alias("unknown")
        )
        found = {r.column: r for r in facts.collect()}
        spare = {c: r.n for c, r in found.items()}
        unknown = {c: r.unknown for c, r in found.items() if r.unknown is not None}
        order = df.columns
        # small dictionaries in one constant map each, without a join
        small = [c for c in self.columns if spare.get(c, 0) <= MAPPED_VALUES]
        rows = self.table.where(F.col("column").isin(small)).collect() if small else []
        maps: dict[str, list] = {c: [] for c in small}
        for r in rows:
            maps[r.column] += [F.lit(r.value), F.lit(r.code)]
        for c in small:
            value = F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN))
            fallback = F.lit(unknown.get(c, spare.get(c, 0))).cast("long")
            code = F.try_element_at(F.create_map(*maps[c]), value) if maps[c] else F.lit(None).cast("long")
            df = df.withColumn(c, F.coalesce(code, fallback))
        for c in self.columns:
            if c in small:
                continue
            codes = self.table.where(F.col("column") == c).select(
                F.col("value").alias("__value"), F.col("code").alias("__code")
            )
            fallback = unknown.get(c, spare.get(c, 0))
            df = (
                df.withColumn("__value", F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)))
                .join(_lookup(codes), "__value", "left")
                .withColumn(c, F.coalesce("__code", F.lit(fallback)))
                .drop("__value", "__code")
            )
        return df.select(*order)


def fit_labels(df: DataFrame, columns: Sequence[str]) -> LabelEncoder:
    """Number the distinct values of each column in string order. The distinct
    values are sorted by sampled ranges, numbered inside each range, and the
    ranges are offset, so neither a column with very many values nor a common
    beginning of them is sorted by one task. The table is written once."""
    text = df.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)).alias(c) for c in columns]
    )
    values = text.unpivot([], list(columns), "column", "value").distinct()
    # written with the range it fell into, since ranges are sampled anew in each run
    values = materialise(
        values.repartitionByRange("column", "value").withColumn("__range", F.spark_partition_id()), "labels"
    )
    groups = values.groupBy("column", "__range").count()
    before = Window.partitionBy("column").orderBy("__range")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(
        "column", "__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first")
    )
    inside = Window.partitionBy("column", "__range").orderBy("value")
    table = (
        values.withColumn("__rank", F.row_number().over(inside) - 1)
        .join(groups, ["column", "__range"])
        .select("column", "value", (F.col("__first") + F.col("__rank")).cast("long").alias("code"))
    )
    return LabelEncoder(materialise(table, "codes"), list(columns))


# --- scaling ----------------------------------------------------------------


@dataclass
class RobustScaler:
    """Median and quartile distance per column; a zero distance divides by 1."""

    stats: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        out = {
            c: (F.col(c) - F.lit(float(mid))) / F.lit(float(width))
            for c, (mid, width) in self.stats.items()
        }
        return df.withColumns(out) if out else df

    def table(self, df: DataFrame) -> DataFrame:
        rows = [(c, float(m), float(w)) for c, (m, w) in self.stats.items()]
        return df.sparkSession.createDataFrame(rows, "feature string, median double, iqr double")


def fit_scaler(df: DataFrame, columns: Sequence[str], exact: bool = True) -> RobustScaler:
    """Fit on the rows given, which should be the training part only."""
    low, mid, high = 0.25, 0.5, 0.75
    found = S.quantiles(df, columns, (low, mid, high), exact)
    return RobustScaler(
        {
            c: (found[c, mid], (found[c, high] - found[c, low]) or 1.0)
            for c in columns
            if found[c, mid] is not None
        }
    )


# --- importance and selection -----------------------------------------------


#: Digits of an importance score. Equal columns may sum in another order, and must tie.
SCORE_DIGITS = 9


@dataclass
class Candidates:
    """Features to be scored against a target: columns, products of two columns,
    and lags of columns by some periods. Only the columns need to exist."""

    columns: Sequence[str]
    products: Sequence[tuple[str, str]] = ()
    lagged: Sequence[str] = ()
    periods: Sequence[int] = ()

    def names(self) -> list[str]:
        return [*self.columns, *self.made()]

    def made(self) -> list[str]:
        lags = [lag_name(c, k) for k in self.periods for c in self.lagged]
        return [*[product_name(a, b) for a, b in self.products], *lags]


def _cuts_array(cuts: Sequence[Sequence[float]]) -> str:
    rows = [f"array({', '.join(S.number(c) for c in own)})" if own else "CAST(array() AS array<double>)" for own in cuts]
    return f"array({', '.join(rows)})"


def _settled(x: str) -> str:
    """SQL: a value to nine places after the point. With single precision after it, values
    that differ by the order of a sum only, near zero too, fall into one bin."""
    value = f"CAST({x} AS DOUBLE)"
    return f"IF(abs({value}) < 1e9, rint({value} * 1e9) / 1e9, {value})"


def score_candidates(
    df: DataFrame,
    candidates: Candidates,
    target: str,
    series: Series | None = None,
    layout: SeriesLayout | None = None,
    bins: int = 10,
    exact: bool = True,
    precise: bool = False,
) -> DataFrame:
    """(feature, present_share, importance_score) of each candidate: mutual
    information of equal-frequency bins with those of the target, missing read as 0.
    Values are told apart to nine places and in single precision, and scores to
    SCORE_DIGITS, or, if `precise`, both as they are.

    Nothing is made for a candidate. Each row keeps one small number per column
    or product, its bin and whether it is present. A lag has the bins of its
    column, so the lags of all columns by one period are one window function on
    the array of these numbers. Cells are counted in long form per (candidate,
    number, target bin) with map-side combine; that is at most 2 * bins * bins
    counters per candidate. Lags look at rows of `df` only.
    """
    columns, products = list(candidates.columns), list(candidates.products)
    extra = [c for c in candidates.lagged if c not in columns]
    bases = [*columns, *extra]
    keys = series.keys if series and candidates.lagged else []
    kept = (lambda x: S.finite(x)) if precise else lambda x: f"CAST({S.finite(_settled(x), 'FLOAT')} AS FLOAT)"
    made = [f"`{c}`" for c in bases] + [f"`{a}` * `{b}`" for a, b in products] + [f"`{target}`"]
    known = df.where(F.col(target).isNotNull()).selectExpr(
        *[f"`{c}`" for c in keys], f"array({', '.join(map(kept, made))}) AS {S.CELLS}"
    )
    # read by every pass and, last, for the codes
    known = materialise(known, "cells")
    filled = known.select(F.transform(S.CELLS, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias(S.CELLS))
    qs = [i / bins for i in range(1, bins)]
    if exact:
        found = S.cell_quantiles(lambda places: S.array_cells(filled, places), qs)
    else:
        found = S.sketched_quantiles(S.array_cells(filled), qs)
    names, aim = range(len(made) - 1), len(made) - 1
    cuts = [sorted({found[i, q] for q in qs if (i, q) in found}) for i in range(len(made))]

    below = "size(filter(cs, c -> coalesce(x, 0F) > c))"
    coded = f"zip_with(slice({S.CELLS}, 1, {aim}), {_cuts_array(cuts[:aim])}, (x, cs) -> 2 * {below} + IF(x IS NULL, 0, 1))"
    target_bin = f"size(filter({_cuts_array([cuts[aim]])}[0], c -> {S.CELLS}[{aim}] > c))"
    rows = known.selectExpr(*[f"`{c}`" for c in keys], f"{coded} AS __codes", f"{target_bin} AS __by")
    shown = [i for i in names if i < len(columns) or i >= len(bases)]
    whole = len(shown) == len(names)
    arrays = ["__codes"] if whole else [f"transform(array({', '.join(map(str, shown))}), i -> __codes[i])"]
    if candidates.lagged and candidates.periods:
        at = [bases.index(c) for c in candidates.lagged]
        # a row without an earlier one reads 0 and is not present
        none = f"array({', '.join(str(2 * sum(0.0 > c for c in cuts[i])) for i in at)})"
        rows = rows.withColumn("__base", F.expr(f"transform(array({', '.join(map(str, at))}), i -> __codes[i])"))

        def make(f: Frames) -> Recipe:
            out = {f"__lag_{k}": f.lag("__base", k) for k in candidates.periods}
            return Recipe([*out], [Level(add=out)], back=max(candidates.periods))

        rows = add_features(rows, series, [make], layout)
        arrays += [f"coalesce(__lag_{k}, {none})" for k in candidates.periods]
    cells = rows.select("__by", F.posexplode(F.concat(*[F.expr(a) for a in arrays])).alias(S.PLACE, "__code"))
    counted = cells.groupBy(S.PLACE, "__code", "__by").agg(F.count(F.lit(1)).alias("__n"))
    bx = F.floor(F.col("__code") / 2).alias("__bx")
    held = F.when(F.col("__code") % 2 == 1, F.col("__n")).otherwise(0).alias("__held")
    sides = counted.select(S.PLACE, bx, "__by", "__n", held)
    # n ln n over pairs of bins, less those over the bins of either side, and the total
    sets = [[S.PLACE, "__bx", "__by"], [S.PLACE, "__bx"], [S.PLACE, "__by"], [S.PLACE]]
    summed = sides.groupingSets(sets, S.PLACE, "__bx", "__by").agg(
        F.sum("__n").alias("__n"), F.sum("__held").alias("__held"), F.grouping_id().alias("__set")
    )
    n = F.col("__n")
    term = n * F.ln(n.cast("double"))
    signed = F.when(F.col("__set").isin(0, 3), term).otherwise(-term)
    total = F.max("__n")
    score = F.sum(signed) / total
    scored = summed.groupBy(S.PLACE).agg(
        (F.max("__held") / total).alias("present_share"),
        (score if precise else F.round(score, SCORE_DIGITS)).alias("importance_score"),
    )
    return S.by_name(scored, candidates.names())


def mutual_information(
    df: DataFrame, features: Sequence[str], target: str, bins: int = 10, exact: bool = True, precise: bool = False
) -> DataFrame:
    """(feature, importance_score) from equal-frequency bins, missing read as 0."""
    scores = score_candidates(df, Candidates(list(features)), target, bins=bins, exact=exact, precise=precise)
    return scores.select("feature", "importance_score")


def with_position(df: DataFrame) -> DataFrame:
    """`position`, from 0, of each row in the output order of a sorted frame. Rows are
    numbered inside their partition, and partitions are offset by their counts."""
    held = materialise(df.withColumn("__place", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("__place", 33)
    counts = held.groupBy(part.alias("__part")).count()
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    inside = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        held.withColumn("__part", part)
        .join(F.broadcast(first), "__part")
        .withColumn("position", F.col("__first") + inside)
        .drop("__place", "__part", "__first")
    )


def top_features(scores: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Best features per role; equal scores in name order.
    Input (feature, role, importance_score) is one row per column."""
    ranked = Window.partitionBy("role").orderBy(F.col("importance_score").desc(), "feature")
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    return scores.withColumn("rank", F.row_number().over(ranked)).where(
        F.col("rank") <= limit[F.col("role")]
    )


def best_features(
    scores: DataFrame, roles: Roles, limits: dict[str, int], min_present: float = 0.1
) -> tuple[dict[str, list[str]], dict[str, float]]:
    """Per role the features with enough values, the best of them where there are
    more than the limit; and the scores of the chosen. Equal scores go in name order."""
    found = {r.feature: r for r in scores.collect()}
    chosen = {}
    for role, limit in limits.items():
        held = [c for c in getattr(roles, role) if c in found and found[c].present_share > min_present]
        best = set(sorted(held, key=lambda c: (-found[c].importance_score, c))[:limit])
        chosen[role] = [c for c in held if c in best]
    return chosen, {c: found[c].importance_score for cs in chosen.values() for c in cs}


def select_features(
    df: DataFrame,
    roles: Roles,
    target: str,
    limits: dict[str, int],
    min_present: float = 0.1,
    bins: int = 10,
    exact: bool = True,
) -> dict[str, list[str]]:
    """Per role the features with enough values, and the best of them by mutual
    information with the target where there are more than the limit."""
    candidates = list(dict.fromkeys(c for role in limits for c in getattr(roles, role) if c in df.columns))
    if not candidates:
        return {role: [] for role in limits}
    scores = score_candidates(df, Candidates(candidates), target, bins=bins, exact=exact)
    return best_features(scores, roles, limits, min_present)[0]


def importance_table(
    df: DataFrame,
    selected: dict[str, list[str]],
    target: str,
    bins: int = 10,
    exact: bool = True,
) -> DataFrame:
    """(feature, role, importance_score) of the selected features."""
    pairs = [(c, role) for role, cs in selected.items() for c in cs]
    names = list(dict.fromkeys(c for c, _ in pairs))
    roles = df.sparkSession.createDataFrame(pairs, "feature string, role string")
    return mutual_information(df, names, target, bins, exact).join(F.broadcast(roles), "feature")


# --- filling and cleaning ---------------------------------------------------


def fill_gaps(
    df: DataFrame,
    series: Series,
    columns: Sequence[str],
    *,
    backward: bool = False,
    medians: dict[str, float] | None = None,
    modes: dict[str, str] | None = None,
    layout: SeriesLayout | None = None,
) -> DataFrame:
    """Forward fill per entity, on request backward fill (it reads the future),
    then the given medians and modes."""
    if df.isStreaming:
        raise ValueError("gap filling needs row order, which a stream does not have")
    layout = layout or plan_series(df, series)
    frame = layout.open(df).carry({c: F.col(c) for c in columns})
    if backward:
        frame = frame.carry_back({c: F.col(c) for c in columns})
    rest = {c: v for c, v in {**(medians or {}), **(modes or {})}.items() if v is not None}
    filled = frame.close().select(*df.columns)
    return filled.fillna(rest) if rest else filled


def fitted_fill(
    df: DataFrame, columns: Sequence[str], exact: bool = True
) -> tuple[dict, dict]:
    """Medians of the numeric and modes of the text columns of these rows."""
    kinds = dict(df.dtypes)
    numeric = [c for c in columns if kinds[c] != "string"]
    text = [c for c in columns if kinds[c] == "string"]
    medians = {c: v for (c, _), v in S.quantiles(df, numeric, (0.5,), exact).items()}
    modes = {r.feature: r.mode for r in S.modes(df, text).collect()} if text else {}
    return medians, modes


def all_finite(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NaN and infinities made NULL."""
    real = [c for c, k in df.dtypes if k in ("double", "float") and (columns is None or c in columns)]
    return df.withColumns({c: finite(F.col(c)) for c in real}) if real else df


def require_rows(df: DataFrame, least: int | None) -> DataFrame:
    """Raise where a table has fewer rows than asked for; a bounded count."""
    if least is None:
        return df
    found = df.limit(least).count()
    if found < least:
        raise ValueError(f"needs at least {least} rows, found {found}")
    return df


PRICE_COLUMNS = ("open", "high", "low", "close", "volume")


def clean_training_table(
    df: DataFrame,
    series: Series,
    target: str = "target",
    *,
    entity_default: str = UNKNOWN,
    min_rows: int | None = None,
    time_idx: str = "time_idx",
) -> DataFrame:
    """No missing or infinite value is left: rows without a target go, the index
    is renumbered, prices are filled along time and then from the target, other
    numbers by their median or 0, text by its mode or `Unknown`."""
    df = all_finite(df).where(F.col(target).isNotNull())
    kinds = dict(df.dtypes)
    # a default of another type than the column is not applied, so name the rows that have none
    texts = [c for c in series.entity if kinds[c] == "string"]
    df = df.fillna(entity_default, subset=texts) if texts else df
    df = df.dropna(subset=[c for c in series.entity if c not in texts]) if len(texts) < len(series.entity) else df
    require_rows(df, min_rows)
    layout = plan_series(df, series)
    numbered = layout.open(df).number("__idx").close()
    if time_idx in df.columns:
        numbered = numbered.withColumn(time_idx, F.col("__idx"))
    df = numbered.drop("__idx")
    prices = [c for c in PRICE_COLUMNS if c in df.columns and c != target]
    if prices:
        df = fill_gaps(df, series, prices, backward=True, layout=layout)
        df = df.withColumns({c: F.coalesce(F.col(c), F.col(target).cast("double")) for c in prices})
    fixed = {*series.keys, target, time_idx}
    rest = [c for c in df.columns if c not in fixed]
    kinds = dict(df.dtypes)
    medians, modes = fitted_fill(df, rest)
    numbers = {c: medians.get(c) or 0 for c in rest if kinds[c] not in ("string", "boolean")}
    texts = {c: modes.get(c) or UNKNOWN for c in rest if kinds[c] == "string"}
    return df.fillna({**numbers, **texts})


def remaining_gaps(df: DataFrame) -> DataFrame:
    """One row: missing and non-finite cells left, both 0 in a clean table."""
    real = [c for c, k in df.dtypes if k in ("double", "float")]
    missing = [F.count_if(F.col(c).isNull()) for c in df.columns]
    wild = [F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))) for c in real] or [F.lit(0)]
    return df.agg(
        reduce(lambda a, b: a + b, missing).alias("missing"),
        reduce(lambda a, b: a + b, wild).alias("not_finite"),
    )


# --- sequences --------------------------------------------------------------


def split_kinds(df: DataFrame, selected: dict[str, list[str]]) -> dict[str, list[str]]:
    """Columns per role, split into text and category columns and real ones."""
    kinds = dict(df.dtypes)
    out: dict[str, list[str]] = {}
    for role, columns in selected.items():
        held = [c for c in columns if c in kinds]
        text = [c for c in held if kinds[c] == "string" or "category" in c.lower()]
        out[f"{role}_categoricals"] = text
        out[f"{role}_reals"] = [c for c in held if c not in text]
    return out


def with_target_scale(
    df: DataFrame,
    series: Series,
    target: str = "target",
    softplus: bool = False,
    layout: SeriesLayout | None = None,
) -> DataFrame:
    """Mean and deviation of the entity's target; on request the target with
    softplus link, ln(1 + e^x), taken before."""
    layout = layout or plan_series(df, series)
    y = F.col(target)
    if softplus:
        y = F.when(y > 20, y).otherwise(F.log1p(F.exp(F.least(y, F.lit(20.0)))))
    frame = layout.open(df.withColumn("__y", y)).totals(
        {"target_center": F.avg("__y"), "target_scale": F.stddev_samp("__y")}
    )
    return frame.close("__y")


def sequence_samples(
    df: DataFrame,
    series: Series,
    *,
    history: Sequence[str],
    future: Sequence[str] = (),
    target: str = "target",
    encoder: tuple[int, int] = (25, 50),
    horizon: tuple[int, int] = (1, 12),
    last_only: bool = False,
    layout: SeriesLayout | None = None,
) -> DataFrame:
    """One sample per row that has enough rows before and after it.

    `history` structs of the last rows with their relative index, `horizon`
    target values of the next rows, `known` structs of the next rows' known
    columns. last_only keeps each entity's last full sample, for validation.
    """
    layout = layout or plan_series(df, series)
    f = layout.frames
    shortest, longest = encoder
    least, most = horizon
    frame = layout.open(df, back=longest, ahead=most + 1)
    frame = frame.number("__pos").size("__rows")
    held = F.struct("__pos", *[F.col(c) for c in history])
    arrays = {
        "__past": F.collect_list(held).over(f.last(longest)),
        "__next": F.collect_list(F.struct(F.col(target).alias("y"), *future)).over(f.next(most)),
    }
    frame = frame.add(arrays)
    frame = frame.add(
        {
            "history": F.transform(
                "__past",
                lambda r: F.struct(
                    (r["__pos"] - F.col("__pos")).alias("relative_idx"),
                    *[r[c].alias(c) for c in history],
                ),
            ),
            "horizon": F.transform("__next", lambda r: r["y"]),
            "known": F.transform("__next", lambda r: F.struct(*[r[c].alias(c) for c in future]))
            if future
            else F.lit(None),
            "encoder_length": F.size("__past"),
            "decoder_length": F.size("__next"),
        }
    )
    samples = frame.close("__past", "__next").where(
        (F.col("encoder_length") >= shortest) & (F.col("decoder_length") >= least)
    )
    if last_only:
        samples = samples.where(F.col("__pos") == F.col("__rows") - 1 - most)
    return samples.select(
        *series.keys, "encoder_length", "decoder_length", "history", "horizon",
        *(["known"] if future else []),
    )
