"""As-of alignment of irregular points to marks such as bars.

Points and marks are put in one ordered table, so no pair is ever formed. The
table is ordered inside (entity, time cell) only, and what a cell has to know
of the others, its neighbouring mark, comes from a scan over one row per cell.
An entity with very many points is thus spread over its cells. A cell with
more than CELL_ROWS rows is sorted by sampled ranges and cut by the place of
its rows into parts, which are cells like others: neither a second nor a single
instant of an entity is a least size.

Null keys match nothing: marks without time or with a null in their entity are
left out, and such points have no mark. Of marks at one time the greatest
payload counts when looking back and the least when looking ahead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import materialise

KIND, AT, CELL, PART = "__kind", "__at", "__cell", "__part"
PLACE, RUN = "__place", "__run"

#: Rows of one entity that one ordered cell should not exceed.
CELL_ROWS = 500_000
#: A list of at most this many full cells is broadcast.
BROADCAST_CELLS = 100_000
#: Parts that points without a key are dealt to.
KEYLESS_PARTS = 256


def _orderable(df: DataFrame, names: list[str]) -> list[str]:
    return [f.name for f in df.schema.fields if f.name in names and "map<" not in f.dataType.simpleString()]


def _with_parts(rows: DataFrame, entity: list[str], keyed: Column, order: list[Column], salt: Column) -> DataFrame:
    """Rows with PART: 0, but in cells of more than CELL_ROWS rows the place of the row in
    the cell divided by that many. `salt` tells apart rows that `order` does not."""
    keys = [*entity, CELL]
    full = rows.where(keyed).groupBy(*keys).agg(F.count(F.lit(1)).alias(RUN)).where(F.col(RUN) > CELL_ROWS).drop(RUN)
    full = materialise(full, "full-cells")
    found = full.limit(BROADCAST_CELLS + 1).count()
    # points without a key match nothing, so any part will do; together they could fill one task
    spread = F.when(keyed, 0).otherwise(F.pmod(salt, F.lit(KEYLESS_PARTS))).cast("long")
    if not found:
        return rows.withColumn(PART, spread)
    full = F.broadcast(full) if found <= BROADCAST_CELLS else full
    cold = rows.join(full, keys, "left_anti").withColumn(PART, spread)
    sorted_by = [*[F.col(k) for k in keys], *order, salt]
    hot = rows.join(full, keys, "left_semi").repartitionByRange(*sorted_by).sortWithinPartitions(*sorted_by)
    hot = materialise(hot.withColumn(PLACE, F.monotonically_increasing_id()), "full-rows")
    hot = hot.withColumn(RUN, F.shiftright(PLACE, 33))
    runs = hot.groupBy(*keys, RUN).agg(F.count(F.lit(1)).alias("__n"), F.min(PLACE).alias("__low"))
    before = Window.partitionBy(*keys).orderBy(RUN).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    place = F.col("__first") + F.col(PLACE) - F.col("__low")
    # a run is one partition's rows of a cell: as many as full cells and partitions
    runs = F.broadcast(runs) if found <= BROADCAST_CELLS else runs
    hot = hot.join(runs, [*keys, RUN]).withColumn(PART, F.floor(place / CELL_ROWS))
    return cold.unionByName(hot.select(cold.columns))


def aligned(
    points: DataFrame,
    marks: DataFrame,
    entity: list[str],
    at: Column,
    mark_time: str,
    payload: dict[str, Column],
    forward: bool,
    unit: str = "day",
    bounded: bool = False,
) -> DataFrame:
    """Points with each payload taken from the nearest mark on one side at
    which that payload is present. Payloads travel under names of their own; one
    that is named like a column of the points comes out as `{name}_mark`.
    `bounded` tells that no cell is longer than a task should order, and saves the count."""
    names, payload = list(payload), {f"__mark_{n}": c for n, c in payload.items()}
    shown = {n: n if n not in points.columns else f"{n}_mark" for n in names}
    held = marks.select(*entity, F.col(mark_time).alias(AT), F.lit(1).alias(KIND), *[c.alias(n) for n, c in payload.items()])
    own = _orderable(points, points.columns)
    rows = points.withColumns({AT: at, KIND: F.lit(0)}).unionByName(held.dropna(subset=[*entity, AT]), allowMissingColumns=True)
    rows = rows.withColumn(CELL, F.date_trunc(unit, AT))
    keyed = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*entity, AT]])
    ranked = _orderable(held, list(payload))

    # a mark at the very time of a point counts, so it is met before the point
    turned = (lambda c: F.col(c).desc()) if forward else (lambda c: F.col(c).asc())
    order = [turned(AT), F.col(KIND).desc(), *[turned(n) for n in ranked]]
    if bounded:
        rows = rows.withColumn(PART, F.when(keyed, 0).otherwise(F.pmod(F.xxhash64(*own), F.lit(KEYLESS_PARTS))).cast("long"))
    else:
        rows = _with_parts(rows, entity, keyed, order, F.xxhash64(*own))
    inside = Window.partitionBy(*entity, CELL, PART).orderBy(*order)
    inside = inside.rowsBetween(Window.unboundedPreceding, 0)
    cells = Window.partitionBy(*entity).orderBy(turned(CELL), PART)
    cells = cells.rowsBetween(Window.unboundedPreceding, -1)

    edge = F.min_by if forward else F.max_by
    place = F.struct(AT, *ranked)
    edges = [edge(n, F.when(F.col(n).isNotNull(), place)).alias(f"__edge_{n}") for n in payload]
    table = (
        rows.where(keyed)
        .groupBy(*entity, CELL, PART)
        .agg(*edges)
        .select(*entity, CELL, PART, *[F.last(f"__edge_{n}", ignorenulls=True).over(cells).alias(f"__far_{n}") for n in payload])
    )
    near = rows.withColumns(
        {f"__near_{n}": F.last(n, ignorenulls=True).over(inside) for n in payload}
    ).where(F.col(KIND) == 0)
    found = {shown[n]: F.coalesce(F.col(f"__near___mark_{n}"), F.col(f"__far___mark_{n}")) for n in names}
    return (
        near.drop(*payload)
        .join(table, [*entity, CELL, PART], "left")
        .withColumns(found)
        .drop(KIND, CELL, PART, *[f"__{x}_{n}" for x in ("near", "far") for n in payload])
    )


def asof_forward(
    points: DataFrame,
    marks: DataFrame,
    *,
    entity: list[str],
    at: str,
    mark_time: str,
    payload: dict[str, Column] | None = None,
    bucket: str = "day",
) -> DataFrame:
    """Each point with the first mark at or after it, NULL where there is none."""
    payload = payload or {mark_time: F.col(mark_time)}
    return aligned(points, marks, entity, F.col(at), mark_time, payload, True, bucket).drop(AT)


def asof_backward(
    points: DataFrame,
    marks: DataFrame,
    *,
    entity: list[str],
    at: str,
    mark_time: str,
    payload: dict[str, Column] | None = None,
    bucket: str = "day",
) -> DataFrame:
    """Each point with the last mark at or before it, NULL where there is none."""
    payload = payload or {mark_time: F.col(mark_time)}
    return aligned(points, marks, entity, F.col(at), mark_time, payload, False, bucket).drop(AT)
