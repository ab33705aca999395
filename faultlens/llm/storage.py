"""Tables and files in the folder that every executor shares."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from faultlens.shipping import ship_package

CHECKPOINT_SETTING = "spark.checkpoint.dir"


@functools.cache
def _own_folder() -> tempfile.TemporaryDirectory:
    """A folder of this machine that goes when the process ends."""
    return tempfile.TemporaryDirectory(prefix="faultlens-llm-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``.

    Where the setting is unset and the session has no other machine (tests), it is
    in a folder of this machine; on a cluster that is an error. Every operator with
    Python functions begins here, so this also brings the package to the workers.
    """
    ship_package(spark)
    configured = spark.conf.get(CHECKPOINT_SETTING, None)
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder every executor can reach")
        configured = "file://" + _own_folder().name
    return f"{configured.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, with its lineage cut."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
