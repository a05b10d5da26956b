"""Session defaults and the one place where intermediate tables are written."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(cores: str = "*", name: str = "gradeloom", shuffle_partitions: int | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", "64m")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master may fall
    back to a fresh temporary folder: on a cluster an executor could not read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can read")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="gradeloom-", dir="/tmp")
    return _LOCAL_ROOTS[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{checkpoint_root(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """A write in here gives the disk of its shuffles back when it ends, not when the driver next collects garbage."""
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FILE_CLEANUP)
        else:
            spark.conf.set(FILE_CLEANUP, before)


def write_table(df: DataFrame, tag: str, compression: str | None = None) -> tuple[DataFrame, str]:
    """``df`` as a written table, and its path for ``delete_table``."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    with shuffles_freed(spark):
        df.write.mode("error").parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path), path


def delete_table(spark: SparkSession, path: str) -> None:
    """Remove a written table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that are there."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    return [p for p in paths if hadoop(p).getFileSystem(conf).exists(hadoop(p))]


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage by writing a table: survives lost executors and carries file sizes."""
    return write_table(df, tag)[0]
