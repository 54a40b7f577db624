"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", memory: str = "16g") -> SparkSession:
    """Session for tests and the bench; on a cluster, use the cluster's own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tickloom")
        .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # window work is heavy per byte, so small exchanges keep their width
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.files.maxPartitionBytes", "64m")
        .config("spark.driver.memory", memory)
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: spark.checkpoint.dir, else the checkpoint folder
    of the context. Without either, a folder in the warehouse, which a cluster
    shares too, or on a single machine a temporary folder."""
    context = spark.sparkContext
    if folder := spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "_tickloom_folder", None) or context.getCheckpointDir():
        return folder
    master = context.master
    if master == "local" or master.startswith("local["):
        folder = f"file://{tempfile.mkdtemp(prefix='tickloom-')}"
    else:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tickloom"
    # Spark lets no running session set spark.checkpoint.dir
    context._tickloom_folder = folder
    return folder


def _own_scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tickloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, in the part of this application."""
    return f"{_own_scratch(spark)}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application. Frames that were made from them can't be read after."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_scratch(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of the executors that made it."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a wide table that several jobs read, and read it back. Unlike a
    checkpoint it is columnar, so each of those jobs reads its columns only."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
