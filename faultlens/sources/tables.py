"""Published count tables and stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.operators.relational import latest_wins
from faultlens.operators.rollup import rendered


def trimmed_names(table: DataFrame) -> DataFrame:
    """Header names without surrounding blanks or byte-order mark."""
    return table.toDF(*[c.strip().lstrip("﻿") for c in table.columns])


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """A count table by file type. Cells stay text; coercion is explicit."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return trimmed_names(spark.read.option("header", True).csv(path))
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix in ("xls", "xlsx"):
        raise ValueError(f"{path}: Spark reads no workbooks; save the sheet as CSV")
    raise ValueError(f"{path}: unsupported table format {suffix!r}")


def append_results(results: DataFrame, path: str, batch_id: int) -> None:
    """Store one batch. Writing a batch again replaces it, so a retried batch
    leaves no duplicates."""
    results.write.mode("overwrite").parquet(f"{path}/batch_id={int(batch_id)}")


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored rows, newest batch of each repository."""
    stored = spark.read.option("basePath", path).parquet(path)
    return latest_wins(stored, "repo_url", "batch_id")


def export_csv(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The published text form with a header per part file."""
    rendered(results).withColumns({
        name: F.initcap(F.col(f"`{name}`").cast("string"))
        for name in rendered(results).columns if name.startswith("Has ")
    }).write.mode(mode).option("header", True).csv(path)
