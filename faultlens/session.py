"""A local session for tests, benchmarks and first steps."""

from __future__ import annotations

import functools
import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def local_session(app: str = "faultlens", cores: int | None = None) -> SparkSession:
    cores = cores or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder the cluster names; ``fallback`` only where it names none."""
    configured = spark.conf.get(CHECKPOINT_SETTING, None)
    if configured:
        return configured
    if fallback is None:
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder every executor can reach")
    return fallback


@functools.cache
def _own_folder() -> tempfile.TemporaryDirectory:
    return tempfile.TemporaryDirectory(prefix="faultlens-")


def local_folder(spark: SparkSession) -> str | None:
    """A folder of this machine's own, for a session that has no other machine and
    names no shared folder. It goes when the process ends."""
    return _own_folder().name if spark.sparkContext.master.startswith("local[") else None
