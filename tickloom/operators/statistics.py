"""Whole-table statistics of many columns: quantiles, modes, shares, distincts.

Results are a few numbers per column, so they may come to the driver; the
values themselves never do.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import materialise

#: Value ranges that one pass of a quantile selection counts at most, over all columns
#: together; each task holds at most one counter for each.
MOST_GROUPS = 1 << 20
LEAST_BINS, MOST_BINS = 64, 1 << 14
#: More columns than this are written once as one array before a selection.
NARROW = 32
#: Accuracy of the sketches of `exact=False`.
SKETCH_ACCURACY = 10_000


PLACE, CELLS = "__feature_place", "__cells"


def number(x: float) -> str:
    """A double as a SQL literal."""
    x = float(x)
    return f"{x!r}D" if math.isfinite(x) else f"double('{x}')"


_SCANS = ("LogicalRelation", "DataSourceV2ScanRelation", "LogicalRDD", "LocalRelation", "Project", "Filter", "SubqueryAlias")


def written_once(df: DataFrame) -> DataFrame:
    """The frame itself if it is a scan with projections and filters, else written
    and read back, for a fit that passes over it several times."""
    nodes = [df._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() not in _SCANS and not node.nodeName().startswith(("Relation", "Scan")):
            return materialise(df, "fit")
        inner = node.children()
        nodes += [inner.apply(i) for i in range(inner.size())]
    return df


def finite(x: str, kind: str = "DOUBLE") -> str:
    """SQL: a value as a double (by way of another kind), NaN and infinities missing. Ranks are over real numbers."""
    value = x if kind == "DOUBLE" else f"CAST({x} AS {kind})"
    return f"CASE WHEN abs(CAST({x} AS DOUBLE)) < double('inf') THEN CAST({value} AS DOUBLE) END"


def array_cells(df: DataFrame, places: Sequence[int] | None = None) -> DataFrame:
    """(place, value) of the values present in the array column CELLS, of all its places or some."""
    if places is None:
        return df.select(F.posexplode(CELLS).alias(PLACE, "value")).where(F.col("value").isNotNull())
    listed = f"array({', '.join(map(str, places))})"
    some = df.select(F.posexplode(F.expr(f"transform({listed}, i -> {CELLS}[i])")).alias("__k", "value"))
    return some.where(F.col("value").isNotNull()).select(F.expr(f"{listed}[__k]").alias(PLACE), "value")


def distinct_estimate(x: str) -> str:
    """About how many distinct values, within a percent. One sketch object per
    column keeps aggregates over many columns narrow."""
    return f"hll_sketch_estimate(hll_sketch_agg(IF({x} IS NULL, NULL, xxhash64({x})), 14))"


def row_of(df: DataFrame, expressions: list[str]) -> list:
    """One aggregate row. Texts plan much faster than columns built one by one
    where there are hundreds of them."""
    return list(df.selectExpr(*[f"{e} AS c{i}" for i, e in enumerate(expressions)]).first())


@dataclass
class _Range:
    """Values of one place from low to high: all ranks from `first` on, `rows` of them."""

    place: int
    low: float
    high: float
    first: int
    rows: int

    def value(self, rank: int) -> float | None:
        """The value of a rank, where the ends of the range tell it."""
        inside = rank - self.first
        if self.low == self.high or inside == 0:
            return self.low
        return self.high if inside == self.rows - 1 else None


def _around(q: float, rows: int) -> tuple[int, int]:
    """The ranks whose values a quantile lies between."""
    place = q * (rows - 1)
    return math.floor(place), math.ceil(place)


def _with_first(counted: DataFrame, of: str, bucket: str) -> DataFrame:
    """Counts per bucket with the rows in the buckets before and in all of them."""
    along = Window.partitionBy(of).orderBy(bucket)
    before = F.sum("rows").over(along.rowsBetween(Window.unboundedPreceding, -1))
    return counted.withColumns({"first": F.coalesce(before, F.lit(0)), "total": F.sum("rows").over(Window.partitionBy(of))})


_FACTS = (F.count, F.min, F.max)
_NAMES = ("rows", "low", "high")


def _counted(cells: DataFrame, of: str, bucket: Column) -> DataFrame:
    """Rows, least and greatest value per (of, bucket), combined before the shuffle."""
    facts = [f("value").alias(n) for f, n in zip(_FACTS, _NAMES)]
    return cells.groupBy(of, bucket.alias("bucket")).agg(*facts)


def _by_magnitude(cells: DataFrame, qs: Sequence[float]) -> tuple[dict[int, int], list[_Range]]:
    """Rows per place, and the ranges that hold the wanted ranks, from buckets of half
    a natural logarithm, which order all doubles."""
    size = F.floor(2 * (F.ln(F.abs("value")) + 746)).cast("int")
    magnitude = F.when(F.col("value") == 0, 0).when(F.col("value") > 0, size).otherwise(-size)
    counted = _with_first(_counted(cells, PLACE, magnitude), PLACE, "bucket")
    ends = [f(F.lit(q) * (F.col("total") - 1)) for q in qs for f in (F.floor, F.ceil)]
    held = [(r >= F.col("first")) & (r < F.col("first") + F.col("rows")) for r in ends]
    total, found = {}, []
    for r in counted.where(reduce(lambda a, b: a | b, held)).collect():
        total[r[PLACE]] = r.total
        found.append(_Range(r[PLACE], r.low, r.high, r["first"], r.rows))
    return total, found


def _narrowed(cells: DataFrame, ranges: list[_Range], wanted: dict[int, list[int]], most_groups: int) -> list[_Range]:
    """Cut each range into equal widths and keep those that hold a wanted rank."""
    spark = cells.sparkSession
    bins = max(LEAST_BINS, min(MOST_BINS, most_groups // len(ranges)))
    rows = [
        (i, r.place, r.low, r.high, [k - r.first for k in wanted[r.place] if r.first <= k < r.first + r.rows])
        for i, r in enumerate(ranges)
    ]
    # one row per column and quantile at most, as many as the result has
    table = F.broadcast(spark.createDataFrame(rows, "id int, of int, least double, most double, wanted array<long>"))
    inside = (F.col(PLACE) == F.col("of")) & F.col("value").between(F.col("least"), F.col("most"))
    # a range of magnitudes has one sign, so its width is finite
    share = (F.col("value") - F.col("least")) / (F.col("most") - F.col("least"))
    bucket = F.least(F.lit(bins - 1), F.floor(share * bins).cast("int"))
    counted = _with_first(_counted(cells.join(table.drop("wanted"), inside), "id", bucket), "id", "bucket")
    hit = F.exists("wanted", lambda k: (k >= F.col("first")) & (k < F.col("first") + F.col("rows")))
    kept = counted.join(table.select("id", "wanted"), "id").where(hit).collect()
    return [_Range(ranges[r.id].place, r.low, r.high, ranges[r.id].first + r["first"], r.rows) for r in kept]


def cell_quantiles(
    cells_of: Callable[[list[int] | None], DataFrame], qs: Sequence[float], most_groups: int = MOST_GROUPS
) -> dict[tuple[int, float], float]:
    """Linear-interpolated quantiles per place of (place, value) cells without missing values.

    A selection by counting: the first pass counts cells by magnitude, and each
    further one cuts the ranges that hold wanted ranks into equal widths, until the
    ends of a range are the wanted values. A pass is one grouped count with
    map-side combine over all places; it has at most `most_groups` counters (64
    for each range, if these are more), whatever the rows and values, and the
    driver gets one row per place and rank. `cells_of` gives the cells of some
    places, or of all.
    """
    qs = list(qs)
    total, ranges = _by_magnitude(cells_of(None), qs)
    wanted = {p: sorted({k for q in qs for k in _around(q, n)}) for p, n in total.items()}
    values: dict[tuple[int, int], float] = {}
    while ranges:
        still = []
        for r in ranges:
            own = {k: r.value(k) for k in wanted[r.place] if r.first <= k < r.first + r.rows}
            values |= {(r.place, k): v for k, v in own.items() if v is not None}
            if None in own.values():
                still.append(r)
        ranges = _narrowed(cells_of(sorted({r.place for r in still})), still, wanted, most_groups) if still else []
    found = {}
    for p, n in total.items():
        for q in qs:
            low, high = (values[p, k] for k in _around(q, n))
            part = q * (n - 1) - math.floor(q * (n - 1))
            found[p, q] = low if low == high else low * (1 - part) + high * part
    return found


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], qs: Sequence[float], most_groups: int = MOST_GROUPS
) -> dict[tuple[str, float], float | None]:
    """Linear-interpolated quantiles of each column over all rows, missing values left out.
    All columns are selected together in one grouped count per pass."""
    columns = list(dict.fromkeys(columns))
    if not columns or not qs:
        return {}
    cells = F.expr(f"array({', '.join(finite(f'`{c}`') for c in columns)})").alias(CELLS)
    df = df.select(cells)
    # the passes over many columns would each plan and compile all of them
    df = materialise(df, "cells") if len(columns) > NARROW else written_once(df)
    found = cell_quantiles(lambda places: array_cells(df, places), qs, most_groups)
    return {(c, q): found.get((i, q)) for i, c in enumerate(columns) for q in qs}


def quantiles(
    df: DataFrame, columns: Sequence[str], qs: Sequence[float], exact: bool = True
) -> dict[tuple[str, float], float | None]:
    """Exact quantiles, or sketched ones from a single pass."""
    columns, qs = list(dict.fromkeys(columns)), list(qs)
    if exact or not columns or not qs:
        return exact_quantiles(df, columns, qs)
    cells = df.select(F.expr(f"array({', '.join(finite(f'`{c}`') for c in columns)})").alias(CELLS))
    found = sketched_quantiles(array_cells(cells), qs)
    return {(c, q): found.get((i, q)) for i, c in enumerate(columns) for q in qs}


def sketched_quantiles(cells: DataFrame, qs: Sequence[float]) -> dict[tuple[int, float], float]:
    """As `cell_quantiles`, from one pass with a sketch per place."""
    asked = F.array(*[F.lit(float(q)) for q in qs])
    rows = cells.groupBy(PLACE).agg(F.percentile_approx("value", asked, SKETCH_ACCURACY).alias("found")).collect()
    return {(r[PLACE], q): v for r in rows for q, v in zip(qs, r.found)}


def quartile_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, q25, median, q75)."""
    found = exact_quantiles(df, columns, (0.25, 0.5, 0.75))
    rows = [(c, *[found[c, q] for q in (0.25, 0.5, 0.75)]) for c in columns]
    return df.sparkSession.createDataFrame(
        rows, "feature string, q25 double, median double, q75 double"
    )


def long_form(
    df: DataFrame, columns: Sequence[str], kind: str, keep: Sequence[str] = ()
) -> DataFrame:
    """(keep..., place, value): one row per cell, features by their place in
    `columns`. Grouping by a small number is cheaper than by a name, and one
    array plans far smaller than a projection per column."""
    cells = F.array(*[F.col(c).cast(kind) for c in columns])
    return df.select(*keep, F.posexplode(cells).alias(PLACE, "value"))


def by_name(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace the place by the name, as `feature`."""
    names = F.array(*[F.lit(c) for c in columns])
    rest = [c for c in df.columns if c != PLACE]
    return df.select(F.get(names, F.col(PLACE)).alias("feature"), *rest)


def _by_kind(df: DataFrame, columns: Sequence[str]) -> list[tuple[str, list[str]]]:
    kinds = dict(df.dtypes)
    text = [c for c in columns if kinds[c] == "string"]
    return [(k, cs) for k, cs in (("double", [c for c in columns if c not in text]), ("string", text)) if cs]


def distinct_ratios(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """(feature, rows, distinct_values, distinct_ratio), NULL not counted as a value."""
    rows = F.count(F.lit(1)).alias("rows")
    distinct = F.expr(distinct_estimate("value")) if approximate else F.count_distinct("value")
    parts = [
        by_name(long_form(df, cs, kind).groupBy(PLACE).agg(rows, distinct.alias("distinct_values")), cs)
        for kind, cs in _by_kind(df, columns)
    ]
    table = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return table.select(
        "feature",
        "rows",
        "distinct_values",
        F.try_divide(F.col("distinct_values"), F.col("rows")).alias("distinct_ratio"),
    )


def nearly_constant(df: DataFrame, columns: Sequence[str], threshold: float = 0.01) -> set[str]:
    """Columns whose distinct ratio is below the threshold.

    Sketches settle most columns in one pass without a shuffle of values; only
    those near the threshold are counted exactly.
    """
    if not columns:
        return set()
    rough = {r.feature: r.distinct_ratio for r in distinct_ratios(df, columns, True).collect()}
    close = [c for c in columns if 0.8 * threshold <= (rough[c] or 0.0) <= 1.25 * threshold]
    exact = (
        {r.feature: r.distinct_ratio for r in distinct_ratios(df, close).collect()} if close else {}
    )
    ratio = {**rough, **exact}
    return {c for c in columns if ratio[c] is not None and ratio[c] < threshold}


def present_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, present_share): part of the rows that hold a value."""
    rows = F.count(F.lit(1))
    shares = [F.try_divide(F.count(c), rows).alias(c) for c in columns]
    return df.agg(*shares).unpivot([], list(columns), "feature", "present_share")


def missing_share(columns: Sequence[str]) -> Column:
    """Aggregate: missing cells of the columns in percent."""
    missing = " + ".join(f"count_if(`{c}` IS NULL)" for c in columns)
    return F.expr(f"try_divide({missing}, count(1) * {len(columns)}) * 100")


def missing_percentage(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: missing cells of the table in percent."""
    return df.agg(missing_share(columns or df.columns).alias("missing_percentage"))


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, mode, copies): most frequent value as text, smallest on ties."""
    parts = []
    for kind, cs in _by_kind(df, columns):
        counted = (
            long_form(df, cs, kind).where(F.col("value").isNotNull()).groupBy(PLACE, "value").count()
        )
        # most copies first, then the smallest value: combined before the shuffle
        top = counted.groupBy(PLACE).agg(F.max("count").alias("copies"))
        best = (
            counted.join(F.broadcast(top), PLACE)
            .where(F.col("count") == F.col("copies"))
            .groupBy(PLACE, "copies")
            .agg(F.min("value").cast("string").alias("mode"))
        )
        parts.append(by_name(best, cs).select("feature", "mode", "copies"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def coverage_report(
    df: DataFrame, time: str, columns: Sequence[str], expected: Sequence[str] = ()
) -> DataFrame:
    """(feature, coverage, first_valid, last_valid); absent expected names get 0."""
    held = [c for c in columns if c in df.columns]
    facts = [
        F.struct(
            F.coalesce(F.try_divide(F.count(c), F.count(F.lit(1))) * 100, F.lit(0.0)).alias("coverage"),
            F.min(F.when(F.col(c).isNotNull(), F.col(time))).alias("first_valid"),
            F.max(F.when(F.col(c).isNotNull(), F.col(time))).alias("last_valid"),
        ).alias(c)
        for c in held
    ]
    found = df.agg(*facts).unpivot([], held, "feature", "fact").select("feature", "fact.*")
    wanted = list(dict.fromkeys([*held, *expected]))
    names = df.sparkSession.createDataFrame([(n,) for n in wanted], "feature string")
    return names.join(found, "feature", "full_outer").fillna(0.0, subset=["coverage"])
