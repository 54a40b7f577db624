"""Text columns in Arrow batches: slices of bounded size, words, bounded caches."""

from __future__ import annotations

import ctypes
import os
import weakref
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SLICE_BYTES = 4 << 20
#: most bytes of a batch between Spark and its Python workers; both sides hold several batches at a time
BATCH_BYTES = 4 << 20
KEPT_ENTRIES = 250_000


def ready_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it. On a
    cluster where it is not installed there, submit it with --py-files. Batches
    for workers are bounded by bytes, since 10,000 rows of text can be any size."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(limit).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(limit, BATCH_BYTES)
    home, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, home])


def slices(
    batches: Iterable[pa.RecordBatch], most: int = SLICE_BYTES, size_of: Callable[[pa.Array], np.ndarray] | None = None
) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with about `most` bytes of text; a longer row stands alone.
    `size_of` tells the bytes of each text where they are not those of the column."""
    forget_others()
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column("text")
        sizes = size_of(text) if size_of else pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
        block = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[:-1] // most
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(a, b - a)
    give_back()


def this_stage() -> int | None:
    """The stage whose task runs here; None outside of tasks."""
    context = TaskContext.get()
    return context.stageId() if context else None


def forget_others() -> None:
    """Empty what other stages have kept: a worker lives on, and their values are of no use to this one."""
    stage = this_stage()
    for own in Kept.all:
        if stage is not None and own.stage != stage:
            own.kept.clear()


def then_given_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same, and at its end, when it holds nothing any more, freed memory is returned."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def give_back() -> None:
    """Return freed memory to the system: a worker lives on through the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def map_texts(docs: DataFrame, schema: str, work: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """Apply `work` to slices of (doc_id, text); it returns columns named as in `schema`."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            made = work(piece)
            yield pa.RecordBatch.from_arrays([pa.array(made[n]) if not isinstance(made[n], pa.Array) else made[n] for n in names], names)

    ready_workers(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def add_columns(docs: DataFrame, schema: str, work: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """All columns of `docs` and those of `schema` (names that begin with tl_), which `work` makes of a slice."""
    ready_workers(docs.sparkSession)
    old, added = docs.columns, StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            made = work(piece)
            columns = [*(piece.column(n) for n in old), *(pa.array(made[f.name]) for f in added)]
            yield pa.RecordBatch.from_arrays(columns, [*old, *added.names])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added.fields]))


class Parts:
    """The parts of each text of a slice: `distinct` parts, the code of every part
    end to end, and the place where each text's parts begin."""

    def __init__(self, lists: pa.ListArray, kind: pa.DataType):
        encoded = lists.flatten().dictionary_encode()
        codes = encoded.indices.to_numpy(zero_copy_only=False)
        # by way of numpy, which makes the objects at once and not through a scalar for each
        self.distinct: list = encoded.dictionary.cast(kind).to_numpy(zero_copy_only=False).tolist()
        edges = lists.offsets.to_numpy().astype(np.int64)
        empty = kind == pa.string() and "" or b""
        if empty in self.distinct:
            gone = self.distinct.index(empty)
            self.distinct.pop(gone)
            edges = np.concatenate([[0], np.cumsum(codes != gone)])[edges]
            codes = codes[codes != gone]
            codes = codes - (codes > gone)
        self.codes, self.edges, self.sizes = codes.astype(np.int64), edges, np.diff(edges)
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def of(self, row: int) -> list:
        """The parts of one text."""
        return [self.distinct[c] for c in self.codes[self.edges[row] : self.edges[row + 1]].tolist()]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum over each text of a value per part."""
        return np.bincount(self.owner, weights=values, minlength=len(self.sizes))


def words_of(column: pa.Array, lower: bool = False) -> Parts:
    """Runs of characters other than ASCII white space, as bytes; a null has none."""
    column = pc.fill_null(column.cast(pa.string()), "")
    return Parts(pc.ascii_split_whitespace(pc.ascii_lower(column) if lower else column), pa.binary())


def parts_of(texts: list[str]) -> Parts:
    """Parts between single spaces."""
    return Parts(pc.split_pattern(pa.array(texts, pa.string()), " "), pa.string())


class Kept:
    """Values of text parts, computed in batches; the first `most` parts met in a stage are kept."""

    all: weakref.WeakSet[Kept] = weakref.WeakSet()

    def __init__(self, compute: Callable[[list], list], most: int = KEPT_ENTRIES):
        self.compute, self.most, self.kept, self.stage = compute, most, {}, None
        Kept.all.add(self)

    def values(self, distinct: list) -> list:
        """The value of each of these different parts."""
        self.stage = this_stage()
        found = list(map(self.kept.get, distinct))
        new = [k for k, value in enumerate(found) if value is None]
        parts = [distinct[k] for k in new]
        made = self.compute(parts) if new else []
        for k, value in zip(new, made):
            found[k] = value
        room = max(0, self.most - len(self.kept))
        self.kept.update(zip(parts[:room], made[:room]))
        return found


def bounds(lengths: Iterable[int]) -> np.ndarray:
    """Start of each run of a concatenation, and its end."""
    return np.concatenate([[0], np.cumsum(np.fromiter(lengths, np.int64))])
