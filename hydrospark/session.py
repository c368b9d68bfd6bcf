"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every job here relies on (UTC calendar, AQE)."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    return configure(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("hydrospark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only where all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="hydrospark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


_RUNS: list[str] = []


def run_dir(spark: SparkSession, label: str) -> str:
    """A new folder below the checkpoint root for one run of one job; `clear_runs` removes it."""
    _RUNS.append(f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return _RUNS[-1]


def clear_runs(spark: SparkSession) -> None:
    """Remove the folders of the jobs of this process, once their results have been written elsewhere."""
    while _RUNS:
        place = spark._jvm.org.apache.hadoop.fs.Path(_RUNS.pop())
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
