"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def configure(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings the operators rely on; the rest stays as the cluster set it."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pagetide")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
    )
    spark = configure(builder.getOrCreate())
    if not _shared_root(spark):
        # driver and executors are this one process: its own temporary folder is shared by all
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pagetide-"))
    return spark


def _shared_root(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's checkpoint directory.

    Every executor must reach it, so it is the directory that the session names; a session that
    names none is refused.
    """
    root = _shared_root(spark)
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/pagetide/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it back: it survives lost executors and is computed once."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def require_zoned(df: DataFrame, *columns: str) -> DataFrame:
    """Refuse columns that are not zoned timestamps, before any work is planned."""
    for column in columns:
        kind = df.schema[column].dataType
        if not isinstance(kind, T.TimestampType):
            raise TypeError(f"{column}: expected a timestamp with time zone, got {kind.simpleString()}")
    return df
