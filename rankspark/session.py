"""Session helpers: local sessions for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "rankspark") -> SparkSession:
    """A local session configured like the tests and the bench expect.

    On a cluster the caller's session is used as is; nothing here is required there.
    """
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("RANKSPARK_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; only a local session (tests) without the setting gets a
    fresh scratch folder, which is registered. Any other session without it raises: executors would
    write to folders that nobody else sees.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="rankspark-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def stored(df: DataFrame, name: str = "table", *partition_by: str) -> DataFrame:
    """Write a (narrow) table to the shared folder and read it back: several passes then read the
    result instead of computing it again, it survives lost executors, and nothing stays cached.
    With ``partition_by`` columns a filter on them reads only the folders it needs."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/rankspark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=list(partition_by) or None)
    kept = spark.read.schema(df.schema).parquet(path)
    return kept.select(*df.columns) if partition_by else kept
