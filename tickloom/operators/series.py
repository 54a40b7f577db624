"""Ordered series per entity, and their split into chunks when an entity is long.

A Spark window handles one partition key in one task. Where an entity may hold
more rows than a task should, `plan_series` cuts its time line into chunks of
about `chunk_rows` rows and every chunk gets the rows before (and after) it
that its frames look at. Running totals, fills and row numbers use per-chunk
results and a scan over the small chunk table instead of one long window.

Rows need a non-null entity and time; `time` plus `ties` must order them fully.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.session import cut_lineage, materialise

CHUNK = "__chunk"
ROLE = "__role"  # -1 copied from before, 0 own, 1 copied from after
START = "__chunk_start"
TOTAL = "__entity_rows"
BUCKET = "__bucket"
HELPERS = (CHUNK, ROLE, START, TOTAL, BUCKET)

#: A chunk table with at most this many rows (some tens of bytes each) is
#: broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Series:
    """What identifies and orders a series.

    max_rows is a bound the caller can prove for the rows of any entity, such
    as the number of slots of a fixed time grid. Within `chunk_rows` it saves
    the counting job.
    """

    entity: tuple[str, ...]
    time: str
    ties: tuple[str, ...] = ()
    bucket: str = "day"
    chunk_rows: int = 500_000
    max_rows: int | None = None

    @property
    def keys(self) -> list[str]:
        return [*self.entity, self.time, *self.ties]

    def bucket_of(self, time: Column | None = None) -> Column:
        return F.date_trunc(self.bucket, F.col(self.time) if time is None else time)


@dataclass(frozen=True)
class Frames:
    """Window specifications of one series, in plain or chunked form."""

    series: Series
    chunked: bool = False

    # Specifications are made once per instance: each costs several calls into
    # the JVM, and wide feature sets use them hundreds of times.

    @cached_property
    def partition(self) -> list[str]:
        return [*self.series.entity, *([CHUNK] if self.chunked else [])]

    @cached_property
    def order(self) -> WindowSpec:
        return Window.partitionBy(*self.partition).orderBy(self.series.time, *self.series.ties)

    @cached_property
    def reverse(self) -> WindowSpec:
        keys = [F.col(c).desc() for c in (self.series.time, *self.series.ties)]
        return Window.partitionBy(*self.partition).orderBy(*keys)

    @cached_property
    def whole(self) -> WindowSpec:
        return self.order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    @cached_property
    def so_far(self) -> WindowSpec:
        return self.order.rowsBetween(Window.unboundedPreceding, 0)

    @cached_property
    def before(self) -> WindowSpec:
        return self.order.rowsBetween(Window.unboundedPreceding, -1)

    @cached_property
    def from_here(self) -> WindowSpec:
        """Rows from here to the end, as a growing frame in reverse order."""
        return self.reverse.rowsBetween(Window.unboundedPreceding, 0)

    @cached_property
    def _rows(self) -> dict[tuple[int, int], WindowSpec]:
        return {}

    def rows(self, first: int, last: int) -> WindowSpec:
        if (first, last) not in self._rows:
            self._rows[first, last] = self.order.rowsBetween(first, last)
        return self._rows[first, last]

    def last(self, n: int) -> WindowSpec:
        return self.rows(-(n - 1), 0)

    def next(self, n: int) -> WindowSpec:
        return self.rows(1, n)

    def around(self, k: int) -> WindowSpec:
        return self.rows(-k, k)

    @cached_property
    def _full(self) -> dict[tuple[str, int], Column]:
        return {}

    def full(self, x: str, n: int) -> Column:
        """True where the last n rows all hold a value of column x."""
        if (x, n) not in self._full:
            self._full[x, n] = F.count(x).over(self.last(n)) == n
        return self._full[x, n]

    def lag(self, x: Column | str, k: int = 1) -> Column:
        return F.lag(x, k).over(self.order)

    def lead(self, x: Column | str, k: int = 1) -> Column:
        return F.lead(x, k).over(self.order)


@dataclass
class SeriesFrame:
    """A DataFrame opened for window work, see `SeriesLayout.open`."""

    df: DataFrame
    frames: Frames
    small: bool = False  # whether a row per chunk may be broadcast

    @property
    def series(self) -> Series:
        return self.frames.series

    def add(self, columns: dict[str, Column]) -> "SeriesFrame":
        return replace(self, df=self.df.withColumns(columns)) if columns else self

    def scan(
        self,
        cumulate: dict[str, Column] | None = None,
        carry: dict[str, Column] | None = None,
        carry_back: dict[str, Column] | None = None,
    ) -> "SeriesFrame":
        """Columns that depend on all rows before (or after) a row.

        cumulate: running sums; a row whose value is missing keeps a missing sum.
        carry: last present value up to each row. carry_back: first present
        value from each row on, which looks ahead.

        In a chunked frame one row per chunk is summed up from the columns that the
        values are made of, scanned along the entity, written and joined back; the
        rows themselves are not written. Filled values
        are then exact on own rows only, so a filled column that other frames
        read is made before the frame is opened with copied rows.
        """
        cumulate, carry, carry_back = cumulate or {}, carry or {}, carry_back or {}
        wanted = {**cumulate, **carry, **carry_back}
        if not wanted:
            return self
        f = self.frames
        raw = {n: F.col(f"__x_{n}") for n in wanted}
        staged = self.add({f"__x_{n}": c for n, c in wanted.items()})
        local = {n: F.sum(raw[n]).over(f.so_far) for n in cumulate}
        local |= {n: F.last(raw[n], ignorenulls=True).over(f.so_far) for n in carry}
        local |= {n: F.last(raw[n], ignorenulls=True).over(f.from_here) for n in carry_back}

        if not f.chunked:
            local |= {n: F.when(raw[n].isNotNull(), local[n]) for n in cumulate}
            return staged.add(local).drop(*[f"__x_{n}" for n in wanted])

        entity = list(self.series.entity)
        rows = staged.df
        at = F.struct(self.series.time, *self.series.ties)
        known = {n: F.when(raw[n].isNotNull(), at) for n in wanted}
        summary = {n: F.sum(raw[n]) for n in cumulate}
        summary |= {n: F.max_by(raw[n], known[n]) for n in carry}
        summary |= {n: F.min_by(raw[n], known[n]) for n in carry_back}
        along = Window.partitionBy(*entity).orderBy(CHUNK)
        along = along.rowsBetween(Window.unboundedPreceding, -1)
        against = Window.partitionBy(*entity).orderBy(F.col(CHUNK).desc())
        against = against.rowsBetween(Window.unboundedPreceding, -1)
        passed = {n: F.sum(f"__s_{n}").over(along) for n in cumulate}
        passed |= {n: F.last(f"__s_{n}", ignorenulls=True).over(along) for n in carry}
        passed |= {n: F.last(f"__s_{n}", ignorenulls=True).over(against) for n in carry_back}
        # one row per chunk, from the columns its values are made of; only this is written
        chunks = cut_lineage(
            rows.where(F.col(ROLE) == 0)
            .groupBy(*f.partition)
            .agg(*[c.alias(f"__s_{n}") for n, c in summary.items()])
            .withColumns({f"__c_{n}": c for n, c in passed.items()})
            .select(*f.partition, *[f"__c_{n}" for n in wanted])
        )
        # sums over the copied rows in front belong to the chunks before
        copied = {
            f"__h_{n}": F.sum(F.when(F.col(ROLE) == -1, raw[n])).over(f.whole) for n in cumulate
        }
        # the chunk table of the layout bounds its rows
        chunks = F.broadcast(chunks) if self.small else chunks
        df = rows.join(chunks, f.partition, "left").withColumns({**local, **copied})
        zero = F.lit(0)
        done = {
            n: F.when(
                raw[n].isNotNull(),
                F.coalesce(F.col(f"__c_{n}"), zero)
                + F.col(n)
                - F.coalesce(F.col(f"__h_{n}"), zero),
            )
            for n in cumulate
        }
        done |= {n: F.coalesce(F.col(n), F.col(f"__c_{n}")) for n in [*carry, *carry_back]}
        helpers = [f"__{p}_{n}" for n in wanted for p in "xch"]
        return replace(self, df=df.withColumns(done)).drop(*helpers)

    def cumulate(self, columns: dict[str, Column]) -> "SeriesFrame":
        return self.scan(cumulate=columns)

    def carry(self, columns: dict[str, Column]) -> "SeriesFrame":
        return self.scan(carry=columns)

    def carry_back(self, columns: dict[str, Column]) -> "SeriesFrame":
        return self.scan(carry_back=columns)

    def number(self, name: str) -> "SeriesFrame":
        """Row position 0, 1, 2 ... per entity."""
        f = self.frames
        place = (F.row_number().over(f.order) - 1).cast("long")
        if f.chunked:
            copied = F.sum((F.col(ROLE) == -1).cast("long")).over(f.whole)
            place = F.col(START) + place - copied
        return self.add({name: place})

    def size(self, name: str) -> "SeriesFrame":
        """Number of rows of the entity."""
        if not self.frames.chunked:
            return self.add({name: F.count(F.lit(1)).over(self.frames.whole)})
        rows = F.count(F.lit(1)).over(self.frames.whole)
        return self.add({name: F.coalesce(F.col(TOTAL), rows)})

    def totals(self, columns: dict[str, Column]) -> "SeriesFrame":
        """Aggregates over all rows of the entity, on each of its rows."""
        if not self.frames.chunked:
            return self.add({n: c.over(self.frames.whole) for n, c in columns.items()})
        entity = list(self.series.entity)
        own = self.df.where(F.col(ROLE) == 0)
        per_entity = own.groupBy(*entity).agg(*[c.alias(n) for n, c in columns.items()])
        per_chunk = cut_lineage(own.select(*entity, CHUNK).distinct().join(per_entity, entity))
        per_chunk = F.broadcast(per_chunk) if self.small else per_chunk
        return replace(self, df=self.df.join(per_chunk, [*entity, CHUNK], "left"))

    def drop(self, *columns: str) -> "SeriesFrame":
        return replace(self, df=self.df.drop(*columns))

    def close(self, *drop: str) -> DataFrame:
        """Own rows only, without the helper columns."""
        df = self.df.where(F.col(ROLE) == 0) if self.frames.chunked else self.df
        return df.drop(*drop, *HELPERS)


CUTS, LEVEL, PART = "__cuts", "__level", "__part"
#: Base of the numbers of bounds; a row is compared with fewer than this many at each level.
FAN = 8


@dataclass
class Cuts:
    """Bounds of the buckets that are cut by rows, as (entity, bucket, level, part, bounds). A bound's
    level is how often FAN divides its number; bounds whose numbers agree but for the digit of their level
    are one block. So a row finds how many bounds it has passed digit by digit, whatever their number."""

    table: DataFrame
    blocks: list[int]  # number of blocks of each level


@dataclass
class SeriesLayout:
    """How the entities of one table are cut; made by `plan_series`."""

    series: Series
    table: DataFrame | None = None
    small: bool = True
    cuts: Cuts | None = None  # of buckets that are cut by rows
    frames: Frames = field(init=False)

    def __post_init__(self) -> None:
        self.frames = Frames(self.series, self.table is not None)

    def open(self, df: DataFrame, back: int = 0, ahead: int = 0) -> SeriesFrame:
        """Frame whose windows see `back` rows before and `ahead` rows after."""
        if self.table is None:
            return SeriesFrame(df, self.frames)
        entity = list(self.series.entity)
        pieces = self._pieces(back, ahead)
        pieces = F.broadcast(pieces) if self.small else pieces
        split = (
            bucketed(df, self.series, self.cuts)
            .join(pieces, [*entity, BUCKET], "left")
            .withColumns(
                {
                    CHUNK: F.coalesce(CHUNK, F.lit(0)),
                    ROLE: F.coalesce(ROLE, F.lit(0)),
                    START: F.coalesce(START, F.lit(0)),
                }
            )
        )
        return SeriesFrame(split, self.frames, self.small)

    def _pieces(self, back: int, ahead: int) -> DataFrame:
        """(entity, bucket) to the chunks that need the bucket's rows."""
        entity = list(self.series.entity)
        table = self.table
        own = table.select(*entity, BUCKET, CHUNK, F.lit(0).alias(ROLE), START, TOTAL)
        along = Window.partitionBy(*entity).orderBy(BUCKET)
        if back > 0:
            reach = Window.partitionBy(*entity).orderBy("__upto").rangeBetween(-(back - 1), 0)
            halo = (
                table.withColumns(
                    {
                        "__copied": F.collect_list(BUCKET).over(reach),
                        "__to": F.lead(CHUNK).over(along),
                        "__to_start": F.lead(START).over(along),
                    }
                )
                .where(F.col("__to") != F.col(CHUNK))
                .select(
                    *entity,
                    F.explode("__copied").alias(BUCKET),
                    F.col("__to").alias(CHUNK),
                    F.lit(-1).alias(ROLE),
                    F.col("__to_start").alias(START),
                    TOTAL,
                )
            )
            own = own.unionByName(halo)
        if ahead > 0:
            reach = Window.partitionBy(*entity).orderBy("__before").rangeBetween(0, ahead - 1)
            halo = (
                table.withColumns(
                    {
                        "__copied": F.collect_list(BUCKET).over(reach),
                        "__to": F.lag(CHUNK).over(along),
                        "__to_start": F.lag(START).over(along),
                    }
                )
                .where(F.col("__to") != F.col(CHUNK))
                .select(
                    *entity,
                    F.explode("__copied").alias(BUCKET),
                    F.col("__to").alias(CHUNK),
                    F.lit(1).alias(ROLE),
                    F.col("__to_start").alias(START),
                    TOTAL,
                )
            )
            own = own.unionByName(halo)
        return own


def bucketed(df: DataFrame, series: Series, cuts: Cuts | None) -> DataFrame:
    """Rows with their bucket: a unit of time, and in buckets that are cut also the
    number of bounds at or before the row."""
    df = df.withColumn(BUCKET, series.bucket_of())
    if cuts is None:
        return df
    keys = [*series.entity, BUCKET, PART]

    def passed(bound: Column) -> Column:
        """As `bound <= struct(time, *ties)`; ties are only looked at where times are equal."""
        time, own = bound[series.time], F.col(series.time)
        if not series.ties:
            return time <= own
        return (time < own) | ((time == own) & (F.struct(*[bound[c] for c in series.ties]) <= F.struct(*series.ties)))

    df = df.withColumn(PART, F.lit(0).cast("long"))
    # the digits of the number, from the first; a row meets one block of each level
    for level, blocks in reversed([*enumerate(cuts.blocks)]):
        own = cuts.table.where(F.col(LEVEL) == level).drop(LEVEL)
        own = F.broadcast(own) if blocks <= BROADCAST_ROWS else own
        digit = F.when(F.col(CUTS).isNull(), 0).otherwise(F.size(F.filter(CUTS, passed)))
        df = df.join(own, keys, "left").withColumn(PART, F.col(PART) * FAN + digit).drop(CUTS)
    return df.withColumn(BUCKET, F.struct(F.col(BUCKET).alias("unit"), F.col(PART).alias("part"))).drop(PART)


def _row_cuts(df: DataFrame, series: Series, long: DataFrame) -> Cuts:
    """Bounds within each long bucket, four for every `chunk_rows` rows, since whole
    parts are copied for the frames of the next chunk. The rows are sorted by sampled
    ranges and numbered inside them, so a bucket is spread over many tasks."""
    step = max(1, series.chunk_rows // 4)
    keys = [*series.entity, BUCKET]
    order = [*keys, series.time, *series.ties]
    rows = df.withColumn(BUCKET, series.bucket_of()).join(long, keys, "left_semi").select(*order)
    held = materialise(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()),
        "long-buckets",
    )
    part = F.shiftright("__place", 33)
    runs = held.groupBy(*keys, part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"), F.min("__place").alias("__low"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    place = F.col("__first") + F.col("__place") - F.col("__low")
    # bounds are numbered from 1 in each bucket, without gaps
    number = F.floor(place / step)
    level = sum(((number % FAN**k == 0).cast("int") for k in range(1, 20)), F.lit(0))
    blocks = cut_lineage(
        held.withColumn("__part", part)
        .join(runs, [*keys, "__part"])
        .where((place % step == 0) & (place > 0))
        .select(*keys, level.alias(LEVEL), number.alias("__number"), F.struct(series.time, *series.ties).alias("__bound"))
        .groupBy(*keys, LEVEL, F.floor(F.col("__number") / F.pow(F.lit(FAN), F.col(LEVEL) + 1)).alias(PART))
        .agg(F.collect_list("__bound").alias(CUTS))
    )
    sizes = {r[LEVEL]: r["count"] for r in blocks.groupBy(LEVEL).count().collect()}
    return Cuts(blocks, [sizes[k] for k in range(len(sizes))])


def plan_series(df: DataFrame, series: Series) -> SeriesLayout:
    """Count rows per entity and decide whether long ones must be cut.

    Runs one column-pruned counting job, or none where `series.max_rows`
    already proves every entity short. Only if an entity is longer than
    `chunk_rows` a chunk table for such entities is made and checkpointed. A
    bucket of time that is longer by itself is cut by its rows; only rows that
    time and ties do not order stay together.
    """
    if series.max_rows is not None and series.max_rows <= series.chunk_rows:
        return SeriesLayout(series)
    entity = list(series.entity)
    longest = df.groupBy(*entity).count().agg(F.max("count")).first()[0]
    if (longest or 0) <= series.chunk_rows:
        return SeriesLayout(series)
    of_entity = Window.partitionBy(*entity)
    along = of_entity.orderBy(BUCKET)
    sizes = df.groupBy(*entity, series.bucket_of().alias(BUCKET)).agg(F.count(F.lit(1)).alias("__n"))
    long = sizes.where(F.col("__n") > series.chunk_rows)
    cuts = None
    if number := long.limit(BROADCAST_ROWS + 1).count():
        # a join by hash would bring all rows of a bucket to one task
        long = F.broadcast(long) if number <= BROADCAST_ROWS else long
        cuts = _row_cuts(df, series, long.select(*entity, BUCKET))
        sizes = bucketed(df, series, cuts).groupBy(*entity, BUCKET).agg(F.count(F.lit(1)).alias("__n"))
    buckets = (
        sizes
        .withColumns(
            {
                TOTAL: F.sum("__n").over(of_entity),
                "__upto": F.sum("__n").over(along.rowsBetween(Window.unboundedPreceding, 0)),
            }
        )
        .where(F.col(TOTAL) > series.chunk_rows)
        .withColumn("__before", F.col("__upto") - F.col("__n"))
        .withColumn(CHUNK, F.floor(F.col("__before") / series.chunk_rows).cast("int"))
        .withColumn(START, F.min("__before").over(Window.partitionBy(*entity, CHUNK)))
    )
    table = cut_lineage(buckets)
    small = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return SeriesLayout(series, table, small, cuts)
