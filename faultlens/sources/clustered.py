"""A result store that is clustered by its key, so that a small batch never moves it.

The store is a folder: a base of the newest row of each key, written in hash buckets of
the key, and the batches that came since. Reading joins the base with the newest rows of
the batches; the base already lies as the join needs it, so only the batches are
shuffled. ``merge_batches`` writes the joined rows as a new base, bucket by bucket,
without a shuffle either.

What counts is in the manifest, a small table with a row for each base and batch. A
base or batch is written first and entered then, so a run that is lost in between
leaves nothing that is read; writing a batch again under its number replaces it. The
catalog holds nothing that lasts: buckets are declared again in each session.

Results in special cases: rows without a key are left out; of rows of one key in one batch the one
with the greatest ``order`` stands; an empty batch changes nothing; columns that a batch
lacks are null there, columns that the store lacks are left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.functions.text import sql_text
from faultlens.operators.relational import latest_wins

MANIFEST = "generation long, kind string, batch long, path string, key string, buckets int, columns string"


def _enter(spark: SparkSession, folder: str, *row) -> None:
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")


def _entries(spark: SparkSession, folder: str) -> list:
    """The manifest's rows of the newest generation: one for the base and one a batch since."""
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    newest = rows.agg(F.max("generation").alias("generation"))
    return rows.join(newest, "generation", "left_semi").distinct().collect()


def _write(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    """Rows in files of hash buckets. The table's name is needed to write, and dropped."""
    name = f"clustered_{uuid.uuid4().hex}"
    rows.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).mode(
        "overwrite").saveAsTable(name)
    rows.sparkSession.sql(f"DROP TABLE {name}")


def _declared(spark: SparkSession, entry) -> DataFrame:
    """The base, with its buckets known to the planner."""
    name = "clustered_" + uuid.uuid5(uuid.NAMESPACE_URL, entry.path).hex
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({entry.columns}) USING parquet "
        f"CLUSTERED BY (`{entry.key}`) SORTED BY (`{entry.key}`) INTO {entry.buckets} BUCKETS "
        f"LOCATION {sql_text(entry.path)}")
    return spark.table(name)


def _one_per_key(rows: DataFrame, key: str, order: str | None) -> DataFrame:
    keyed = rows.where(F.col(f"`{key}`").isNotNull())
    return latest_wins(keyed, key, order) if order else keyed.dropDuplicates([key])


def _columns(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def create_store(rows: DataFrame, folder: str, key: str, buckets: int, order: str | None = None) -> None:
    """A store of ``rows``, the newest of each key. ``buckets`` should leave each bucket a
    size that a task can sort; it stays as it is for the store's life."""
    first = _one_per_key(rows, key, order)
    path = f"{folder}/base-{uuid.uuid4().hex}"
    _write(first.repartition(buckets, key), path, key, buckets)
    _enter(rows.sparkSession, folder, 0, "base", -1, path, key, buckets, _columns(rows))


def append_batch(rows: DataFrame, folder: str, batch: int, order: str | None = None) -> None:
    """Add a batch: nothing but the batch is read or written."""
    spark = rows.sparkSession
    entries = _entries(spark, folder)
    base = next(e for e in entries if e.kind == "base")
    newest = _one_per_key(rows, base.key, order)
    path = f"{folder}/batch-{base.generation}-{int(batch)}"
    newest.write.mode("overwrite").parquet(path)
    _enter(spark, folder, base.generation, "batch", int(batch), path, base.key, base.buckets, _columns(rows))


def load_clustered(spark: SparkSession, folder: str) -> DataFrame:
    """The newest row of each key. The base is not shuffled."""
    entries = _entries(spark, folder)
    base = next(e for e in entries if e.kind == "base")
    rows = _declared(spark, base)
    batches = [
        spark.read.schema(e.columns).parquet(e.path).withColumn("_batch", F.lit(e.batch))
        for e in entries if e.kind == "batch"]
    if not batches:
        return rows
    given = batches[0]
    for batch in batches[1:]:
        given = given.unionByName(batch, allowMissingColumns=True)
    # Dealt as the base is: else the planner would take the wider side's partitioning.
    newest = latest_wins(given.repartition(base.buckets, base.key), base.key, "_batch")
    key = f"_{uuid.uuid4().hex}"
    newest = newest.select(
        F.col(f"`{base.key}`").alias(key), F.struct(*newest.columns).alias("_new"))
    joined = rows.join(newest, F.col(f"`{base.key}`") == F.col(key), "full_outer")
    has = F.col("_new").isNotNull()

    def column(name: str):
        kind = rows.schema[name].dataType
        new = F.col(f"_new.`{name}`").cast(kind) if name in newest.schema["_new"].dataType.names else F.lit(None).cast(kind)
        return F.when(has, new).otherwise(F.col(f"`{name}`")).alias(name)

    return joined.select(*map(column, rows.columns))


def aligned(rows: DataFrame, folder: str) -> DataFrame:
    """Other rows dealt as the store is, so that a join on its key shuffles them alone."""
    base = next(e for e in _entries(rows.sparkSession, folder) if e.kind == "base")
    return rows.repartition(base.buckets, base.key)


def merge_batches(spark: SparkSession, folder: str) -> None:
    """Write what stands as a new base. Earlier files stay for readers that have begun."""
    base = next(e for e in _entries(spark, folder) if e.kind == "base")
    path = f"{folder}/base-{uuid.uuid4().hex}"
    _write(load_clustered(spark, folder), path, base.key, base.buckets)
    _enter(spark, folder, base.generation + 1, "base", -1, path, base.key, base.buckets, base.columns)
