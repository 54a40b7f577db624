"""Table scans, sinks and input checks."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tickloom.session import materialise

BAR_SCHEMA = (
    "datetime timestamp_ntz, open double, high double, low double, close double, volume double"
)
REQUIRED = ("open", "high", "low", "close", "volume")


def read_csv(spark: SparkSession, path: str, schema: str = BAR_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """Rows of headed CSV files with declared types, and the lines that do not
    parse. A file whose header does not name these columns in order is an error.
    The bad lines are written to the shared folder when this is called."""
    bad = "__bad_line"
    read = (
        spark.read.schema(f"{schema}, {bad} string")
        .option("header", True)
        .option("enforceSchema", False)
        .option("columnNameOfCorruptRecord", bad)
        .csv(path)
    )
    kept = [c for c in read.columns if c != bad]
    good = read.where(F.col(bad).isNull()).select(*kept)
    rejected = read.where(F.col(bad).isNotNull()).withColumnRenamed(bad, "line")
    # written, since the text of a bad line can't be queried without the other columns
    return good, materialise(rejected, "rejects").select("line")


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*dict.fromkeys(columns)) if columns else df


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns that exist, each once, in the order given."""
    return df.select(*[c for c in dict.fromkeys(columns) if c in df.columns])


def of_symbol(df: DataFrame, symbol: str) -> DataFrame:
    return df.where(F.col("symbol") == symbol)


def validation_report(bars: DataFrame, time: str = "bar_ts") -> DataFrame:
    """One row: rows, first and last time, names of missing required columns."""
    missing = [c for c in REQUIRED if c not in bars.columns]
    return bars.agg(
        F.count(F.lit(1)).alias("rows"), F.min(time).alias("first_ts"), F.max(time).alias("last_ts")
    ).withColumn("missing_columns", F.lit(",".join(missing)))


def validate_bars(bars: DataFrame, time: str = "bar_ts", min_rows: int = 1) -> DataFrame:
    """The same bars, or an error if columns or rows are missing."""
    report = validation_report(bars, time).first()
    if report.missing_columns:
        raise ValueError(f"missing required columns: {report.missing_columns}")
    if report.rows < min_rows:
        raise ValueError(f"only {report.rows} rows, needs {min_rows}")
    return bars


def write_monthly(
    df: DataFrame, path: str, *, time: str = "bar_ts", by: Sequence[str] = ("symbol",)
) -> None:
    """Parquet per (symbol, month). A re-run replaces only the months it has.
    Rows are dealt by sampled ranges of symbol and time, so a hot month is several
    files, each sorted by time and covering its own range."""
    keys = [*by, "month"]
    (
        df.withColumn("month", F.date_format(time, "yyyy-MM"))
        .repartitionByRange(*keys, time)
        .sortWithinPartitions(*keys, time)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def one_per_key(df: DataFrame, keys: Sequence[str], prefer: Column | None = None) -> DataFrame:
    """One row per key: the greatest `prefer`, such as a load time, and among equals
    the greatest by all columns in order, whatever the partitioning."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    row = F.struct(*rest)
    best = F.max(row) if prefer is None else F.max_by(row, F.struct(prefer, *rest))
    return df.groupBy(*keys).agg(best.alias("__kept")).select(*keys, "__kept.*").select(*df.columns)


def append_rows(
    df: DataFrame, path: str, distinct_on: Sequence[str] | None = None, prefer: Column | None = None
) -> None:
    """Append; with distinct_on only rows whose key the table does not have yet,
    and of repeated keys the row that `one_per_key` takes."""
    if distinct_on:
        keys = list(distinct_on)
        df = one_per_key(df, keys, prefer)
        held = _existing(df.sparkSession, path)
        if held is not None:
            df = df.join(held.select(*keys).distinct(), keys, "left_anti")
    df.write.mode("append").parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    """Headed CSV; `files` bounds the number of files, for results to read by eye."""
    df = df.coalesce(files) if files else df
    df.write.mode("overwrite").option("header", True).csv(path)


def write_document(df: DataFrame, path: str) -> None:
    """Rows as JSON documents."""
    df.write.mode("overwrite").json(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def document(spark: SparkSession, content: dict) -> DataFrame:
    """A one-row table holding a metadata document as JSON text."""
    return spark.createDataFrame([(json.dumps(content, default=str),)], "document string")


def append_run(df: DataFrame, path: str, run_ts: str) -> None:
    """Results of one run; a repeated run replaces its own rows."""
    (
        df.withColumn("run_ts", F.lit(run_ts))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_ts")
        .parquet(path)
    )


def latest_run(df: DataFrame) -> DataFrame:
    """Rows of the newest run. The newest name is one value, so the filter
    prunes to its partition."""
    newest = df.agg(F.max("run_ts")).first()[0]
    return df.where(F.col("run_ts") == F.lit(newest))
