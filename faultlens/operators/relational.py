"""Lookups, ordering, deduplication and batching on DataFrames."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.session import checkpoint_dir, local_folder


def lookup(data: DataFrame, table: DataFrame, key: str, normalise=None) -> DataFrame:
    """Left join on a normalised key; ``matched`` tells a miss from a null
    value. Spark broadcasts the table when its size allows, else shuffles."""
    normalise = normalise or (lambda c: c)
    right = table.withColumn("_key", normalise(F.col(key))).drop(key).withColumn(
        "matched", F.lit(True))
    return (
        data.withColumn("_key", normalise(F.col(key)))
        .join(right, "_key", "left")
        .withColumn("matched", F.coalesce("matched", F.lit(False)))
        .drop("_key")
    )


def unmatched_keys(data: DataFrame, table: DataFrame, key: str, normalise=None) -> DataFrame:
    """Keys of ``data`` the table does not know."""
    normalise = normalise or (lambda c: c)
    wanted = data.select(normalise(F.col(key)).alias("_key"), key)
    known = table.select(normalise(F.col(key)).alias("_key"))
    return wanted.join(known, "_key", "left_anti").select(key).distinct()


def reorder(data: DataFrame, keys: DataFrame, key: str, order: str = "ord",
            strict: bool = True) -> DataFrame:
    """Rows in the order of a key list. A key without a row is an error when
    ``strict``, otherwise it is left out."""
    if not strict:
        return keys.join(data, key).orderBy(order)
    found = keys.join(data.withColumn("_found", F.lit(True)), key, "left")
    checked = F.when(F.col("_found"), F.col(key)).otherwise(
        F.raise_error(F.concat(F.lit("no row for key: "), F.col(key).cast("string"))))
    return found.select(checked.alias(key), *[c for c in found.columns if c not in (key, "_found")]
                        ).orderBy(order)


def zero_fill(counts: DataFrame, domain_table: DataFrame, key: str, value: str = "n") -> DataFrame:
    """Every key of the domain, with zero where no count exists."""
    return domain_table.join(counts, key, "left").withColumn(
        value, F.coalesce(value, F.lit(0)))


def latest_wins(rows: DataFrame, key, order) -> DataFrame:
    """The last row per key. ``max_by`` combines map-side, so a key with any
    number of versions moves one row per task."""
    keys = [key] if isinstance(key, str) else list(key)
    order = [order] if isinstance(order, str) else list(order)
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return newest.select(*keys, "_row.*").select(*rows.columns)


def not_yet_done(rows: DataFrame, done: DataFrame, key) -> DataFrame:
    """Input that has no stored result yet."""
    keys = [key] if isinstance(key, str) else list(key)
    return rows.join(done.select(*keys), keys, "left_anti")


def distinct_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.dropDuplicates(list(keys))


def numbered_rows(rows: DataFrame, order: str, ranges: int | None = None) -> DataFrame:
    """Rows with ``row_number`` from 1, in ``order``, which must be unique.

    One shuffle deals the rows to ranges, in order; they are written to the shared folder
    with their range and their place in it. A row's number is its place plus the rows of
    the ranges before, which is a sum over one row a range. The input is read once and by
    a job of its own, since ranges that were drawn twice could differ; null comes first.
    """
    spark = rows.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    path = f"{checkpoint_dir(spark, local_folder(spark))}/numbered-{uuid.uuid4().hex}"
    rows.repartitionByRange(ranges, order).sortWithinPartitions(order).withColumns(
        {"_range": F.spark_partition_id(), "_place": inside}).write.parquet(path)
    dealt = spark.read.parquet(path)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    # At most ``ranges`` rows.
    return dealt.join(F.broadcast(offsets), "_range").withColumn(
        "row_number", F.col("_place") + F.col("_before") + 1).select(*rows.columns, "row_number")


def numbered_batches(rows: DataFrame, order: str, size: int, ranges: int | None = None
                     ) -> DataFrame:
    """Stable slices of ``size`` rows in ``order``, which must be unique."""
    batch = F.floor((F.col("row_number") - 1) / size).cast("bigint")
    return numbered_rows(rows, order, ranges).withColumn("batch_id", batch).drop("row_number")


def batch_counts(rows: DataFrame, ok: Column, batch: str = "batch_id") -> DataFrame:
    """Successes and failures per batch."""
    return rows.groupBy(batch).agg(
        F.count("*").alias("n_rows"), F.count_if(ok).alias("n_ok"),
        F.count_if(~ok).alias("n_failed"))


def numeric(column: Column, kind: str = "double") -> Column:
    """Number or null, never an error."""
    return F.trim(column).try_cast(kind)
