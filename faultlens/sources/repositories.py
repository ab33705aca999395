"""The list of repositories to analyse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.functions import scalars

# Columns of a published repository list.
_TEXT = ("id", "hostname", "repo_url", "watcher", "forks", "stars", "commits", "last_updated",
         "forked_by", "readme", "language", "category")
SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in _TEXT])
_NUMBERS = ("watcher", "forks", "stars")


def read_repositories(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; a byte-order mark is dropped by the reader. Only the
    columns a query uses are parsed out of each line."""
    raw = spark.read.schema(SCHEMA).option("header", True).option(
        "enforceSchema", False).csv(path)
    return raw.withColumns({
        name: F.col(name).try_cast("int") for name in _NUMBERS
    })


def distinct_repositories(repositories: DataFrame, mode: str = "fixed") -> DataFrame:
    """One row per repository key: owner and name."""
    return repositories.withColumn("repo_key", scalars.repo_key(F.col("repo_url"), mode)
                                   ).dropDuplicates(["repo_key"])
