"""Incremental corpus scans on Structured Streaming.

Each trigger reads new ``files`` Parquet, classifies it with the same
stateless projection as a batch job, and stores the mergeable partial state of
every file it met. A repository may therefore be spread over any number of
drops and batches: reading the store takes each file's newest state and merges a
repository's files, so that a file that is delivered again replaces itself and
nothing else. Replaying a batch overwrites that batch's own folder, so results are
exactly-once.

Results in special cases: files without a path are never replaced; of a path that
repeats within one batch a single row counts; stores whose partials have no path
(one row per repository and batch) are read by repository, newest batch first.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultlens.operators.relational import batch_counts, latest_wins, not_yet_done
from faultlens.operators.rollup import Domains, finish_rollup, merge_partials, partial_rollup
from faultlens.operators.signals import classify_files
from faultlens.session import checkpoint_dir

FILES_SCHEMA = (
    "repo_url string, path string, ext string, language string, content string, "
    "decode_ok boolean, size_bytes bigint"
)


#: What names a file in a store.
FILE = ("repo_url", "path")


def new_files(spark: SparkSession, path: str, files_per_trigger: int = 50,
              schema: str = FILES_SCHEMA) -> DataFrame:
    """Stream of file drops, a bounded number of them per trigger."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("recursiveFileLookup", True)
        .parquet(path)
    )


def _one_per_file(batch: DataFrame) -> DataFrame:
    """One row of each path of a repository, and all rows without a path."""
    rest = [c for c in batch.columns if c not in FILE]
    rows = batch.withColumn("_nameless", F.when(F.col("path").isNull(), F.monotonically_increasing_id()))
    rows = rows.withColumn("_pick", F.xxhash64(*rest))
    return latest_wins(rows, [*FILE, "_nameless"], "_pick").select(*batch.columns)


def start_scan(files: DataFrame, store: str, checkpoint: str | None = None,
               domains: Domains | None = None, **classify) -> StreamingQuery:
    """Scan everything available, then stop. Progress lives under the shared
    checkpoint folder, for each store in a folder of its own, unless ``checkpoint``
    names another."""
    spark = files.sparkSession
    name = hashlib.sha1(store.rstrip("/").encode()).hexdigest()[:16]
    location = checkpoint or f"{checkpoint_dir(spark)}/corpus-scan-{name}"
    signals = classify_files(files, **classify)

    def store_batch(batch: DataFrame, batch_id: int) -> None:
        once = _one_per_file(batch)
        partial_rollup(once, by=FILE, domains=domains).write.mode("overwrite").parquet(
            f"{store}/batch_id={int(batch_id)}")

    return (
        signals.writeStream.foreachBatch(store_batch)
        .option("checkpointLocation", location)
        .trigger(availableNow=True)
        .start()
    )


def stored_partials(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.option("basePath", store).parquet(store)


def _newest(partials: DataFrame, merge: bool) -> DataFrame:
    """The partials that stand, without their batches: one per key of the store."""
    by = [c for c in FILE if c in partials.columns]
    if not merge:
        partials = partials.withColumn("_again", F.when(F.col(by[-1]).isNull(), F.col("batch_id")))
        partials = latest_wins(partials, [*by, "_again"], "batch_id").drop("_again")
    return merge_partials(partials.drop("batch_id"), by)


def current_results(spark: SparkSession, store: str, domains: Domains | None = None,
                    merge: bool = False) -> DataFrame:
    """Repository rows of the store: a file's newest batch replaces earlier ones, and a
    repository's files are added up.

    With ``merge``, batches hold disjoint files of a repository and are added up; a
    file that is delivered twice then counts twice.
    """
    state = _newest(stored_partials(spark, store), merge)
    return finish_rollup(merge_partials(state), domains=domains)


def remaining(repositories: DataFrame, results: DataFrame) -> DataFrame:
    """Repositories without a stored result: where a stopped run resumes."""
    return not_yet_done(repositories, results, "repo_url")


def progress(spark: SparkSession, store: str) -> DataFrame:
    """Repositories per batch: with at least one analysed file, and without."""
    repositories = stored_partials(spark, store).groupBy("batch_id", "repo_url").agg(
        F.sum("failed_files").alias("failed_files"), F.sum("total_files").alias("total_files"))
    return batch_counts(repositories, F.col("failed_files") < F.col("total_files"))


def compact(spark: SparkSession, store: str, target: str, merge: bool = False) -> None:
    """Write what stands into one batch folder of a new store, which answers the same:
    by the rule of ``current_results`` with the same ``merge``."""
    state = _newest(stored_partials(spark, store), merge)
    state.write.mode("overwrite").parquet(f"{target}/batch_id=0")
