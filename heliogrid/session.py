"""A session with the settings that the library relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """For tests and benchmarks; on a cluster, pass your own session with UTC as its time zone."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("heliogrid")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is set, a local one in local mode and an error elsewhere."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="heliogrid-"))
        where = sc.getCheckpointDir()
    return where.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint, for loops that build on it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def few(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df to be broadcast if it has `most` rows or fewer, which are counted; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
