"""Session, table and scratch-folder helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting for the removal of a finished query's shuffle files.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a row group of a scratch table. A reader takes a column of a whole row group at once, on the heap and again in
#: a buffer outside it that its thread keeps, so the default of 128 MB costs an executor hundreds of MB.
ROW_GROUP = 4 << 20


def session(app: str = "attestra", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the queries expect (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path is only ever opened by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster, spark.checkpoint.dir; a temporary one only for a local session without the setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (shared or _own_root()).rstrip("/")


@cache
def _own_root() -> str:
    return tempfile.mkdtemp(prefix="attestra-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{scratch_root(spark)}/attestra/{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system API."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one file through Hadoop's file system API."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    stream.write(data)
    stream.close()


def materialise(df: DataFrame, label: str, codec: str = "snappy") -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to the shared folder and read it back: a cut of lineage that survives lost executors.

    Returns the DataFrame and its path, which the caller may ``discard`` once nothing reads it. The shuffle files of the
    write go when it ends, not when the driver next collects its garbage; what is written no longer needs them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    old = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).option("parquet.block.size", ROW_GROUP).parquet(path)
    finally:
        spark.conf.set(CLEANUP, old)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of at most ``rows`` rows for the jobs that run inside, so that long values don't fill a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(old)) if int(old) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def bound_batches(spark: SparkSession, rows: int = 500) -> None:
    """Lower the session's Arrow batches to ``rows`` rows, for good: for operators whose result runs Python when it is read.

    The setting holds when a plan is made, which for a lazy result is after the operator has returned.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
