"""Session settings the engine relies on, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot join keys: split oversized partitions even where that costs a shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("wardops")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # Recording the Python line of every column costs more than planning does.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's ``spark.checkpoint.dir``.

    Only in local mode, where all tasks share the driver's disk, a temporary
    folder stands in for a missing setting; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local") or "cluster" in spark.conf.get("spark.master", "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="wardops-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


Stage = Callable[[DataFrame], DataFrame]


def keep(frame: DataFrame) -> DataFrame:
    """The default stage: leave the frame lazy."""
    return frame


def stager(spark: SparkSession, purpose: str) -> Stage:
    """A stage that writes frames to the shared folder and reads them back.

    Rules with several outputs stage what the outputs have in common, so it is
    worked out once, plans stay small, and a lost executor costs one re-read.
    """
    folder = shared_folder(spark, purpose)
    count = 0

    def stage(frame: DataFrame) -> DataFrame:
        nonlocal count
        count += 1
        path = f"{folder}/{count}"
        frame.write.parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    return stage
