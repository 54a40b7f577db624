"""A table by month that new rows are merged into by key.

A merge reads the months its rows fall into and no others. It is staged: the new
files are written below `_staged`, where no reader looks, then a note of the months
is left there, and only then are files moved into the table. A write that
fails before the note leaves the table as it was; one that fails after it is
brought to its end by `recover`, which every merge begins with. Merges into one
table must not run at the same time.

The key must determine the time, as an article's or a bar's does: a row whose month
changes between loads is a new row. Rows without a time are kept in a month of
their own.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import materialise
from tickloom.sources.tables import _existing, one_per_key

MONTH, NO_TIME = "month", "none"
STAGED, DATA, OLD, READY = "_staged", "data", "old", "_ready"


class _Folder:
    """Files below a path of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.root, self.Path = path.rstrip("/"), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, *parts: str):
        return self.Path("/".join([self.root, *parts]))

    def has(self, *parts: str) -> bool:
        return self.fs.exists(self.at(*parts))

    def move(self, source: list[str], target: list[str]) -> None:
        self.fs.mkdirs(self.at(*target).getParent())
        if not self.fs.rename(self.at(*source), self.at(*target)):
            raise OSError(f"could not move {self.at(*source)} to {self.at(*target)}")

    def names(self, *parts: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.at(*parts))]

    def write(self, text: str, *parts: str) -> None:
        """A whole file or none: written under another name, then renamed."""
        stream = self.fs.create(self.at(*parts[:-1], f"{parts[-1]}.part"), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.move([*parts[:-1], f"{parts[-1]}.part"], list(parts))

    def read(self, *parts: str) -> str:
        stream = self.fs.open(self.at(*parts))
        text = bytes(stream.readAllBytes()).decode()
        stream.close()
        return text

    def drop(self, *parts: str) -> None:
        self.fs.delete(self.at(*parts), True)


def _swap_month(folder: _Folder, month: str, replace: bool) -> None:
    """Move one month's staged files into the table. What was moved before is not there any more."""
    new, now = [STAGED, DATA, f"{MONTH}={month}"], [f"{MONTH}={month}"]
    if not folder.has(*new):
        return
    if replace:
        if folder.has(*now):
            folder.move(now, [STAGED, OLD, f"{MONTH}={month}"])
        folder.move(new, now)
        return
    for name in folder.names(*new):
        folder.move([*new, name], [*now, name])


def recover(spark: SparkSession, path: str) -> None:
    """End a merge that was interrupted: go on if it was ready, else drop its files."""
    folder = _Folder(spark, path)
    if folder.has(STAGED, READY):
        note = json.loads(folder.read(STAGED, READY))
        for month in note["months"]:
            _swap_month(folder, month, note["replace"])
    if folder.has(STAGED):
        folder.drop(STAGED)


def _months_of(held: DataFrame, months: list[str]) -> DataFrame:
    """Rows of these months; the filter prunes to their folders."""
    return held.where(F.col(MONTH).cast("string").isin(months))


def merge_rows(df: DataFrame, path: str, keys: Sequence[str], time: str, prefer: str | None = None) -> None:
    """Merge rows into the table at `path` by key.

    Without `prefer` a key the table has is left as it is, and only files with new rows
    are added. With it, the row with the greatest `prefer` of table and news
    counts (of equals the greatest row), and the touched months are replaced.
    """
    spark, keys = df.sparkSession, list(keys)
    recover(spark, path)
    order: Column | None = None if prefer is None else F.col(prefer)
    month = F.coalesce(F.date_format(time, "yyyy-MM"), F.lit(NO_TIME))
    new = materialise(one_per_key(df, keys, order).withColumn(MONTH, month), "merged")
    months = sorted(r[0] for r in new.select(MONTH).distinct().collect())
    if not months:
        return
    held = _existing(spark, path)
    rows = new
    if held is not None:
        touched = _months_of(held, months).withColumn(MONTH, F.col(MONTH).cast("string"))
        if prefer is None:
            rows = new.join(touched.select(*keys), keys, "left_anti")
        else:
            rows = one_per_key(touched.select(*new.columns).unionByName(new), keys, order)
    folder = _Folder(spark, path)
    dealt = rows.repartitionByRange(MONTH, *keys).sortWithinPartitions(MONTH, *keys)
    dealt.write.partitionBy(MONTH).parquet(f"{folder.root}/{STAGED}/{DATA}")
    folder.write(json.dumps({"months": months, "replace": prefer is not None}), STAGED, READY)
    recover(spark, path)
