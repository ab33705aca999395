"""Source files: from a directory tree, and packed into Parquet.

A tree of small files is read once and packed; every later scan reads columns
of large Parquet files and prunes by language.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.catalogs import domain
from faultlens.functions import scalars, text


def decoded(content: Column) -> tuple[Column, Column]:
    """(text, decode_ok). UTF-8 only: other bytes are flagged, never guessed."""
    ok = F.is_valid_utf8(content.cast("string"))
    return F.when(ok, F.decode(content, "UTF-8")), ok


def select_files(listing: DataFrame) -> DataFrame:
    """Supported files outside pruned directories, with their language."""
    path = F.col("path")
    return listing.where(scalars.is_supported(path) & ~scalars.in_skipped_directory(path)
                         ).withColumns({
        "ext": scalars.extension(path), "language": scalars.language_of(path)})


def read_source_tree(spark: SparkSession, root: str) -> DataFrame:
    """``root/<repository>/<path...>`` to the ``files`` table.

    The extension filter acts on the listing, so other files are never opened.
    """
    endings = ",".join(domain.EXTENSION_LANGUAGE)
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*{" + endings + "}")
        .load(root)
    )
    # Cut after the root where the path begins with it, else after its first occurrence.
    base = re.sub(r"^[A-Za-z][\w+.-]*:(//[^/]*)?", "", root).rstrip("/") + "/"
    whole = F.regexp_replace("path", r"^[A-Za-z][\w+.-]*:(//[^/]*)?", "")
    inside = F.when(whole.startswith(base), F.substr(whole, F.lit(len(base) + 1))).otherwise(
        F.substr(whole, F.instr(whole, base) + F.lit(len(base))))
    placed = found.select(
        F.substring_index(inside, "/", 1).alias("repo_url"),
        F.regexp_replace(inside, "^[^/]*/", "").alias("path"),
        "content", F.col("length").alias("size_bytes"),
    )
    body, ok = decoded(F.col("content"))
    chosen = select_files(placed)
    return chosen.select(
        "repo_url", "path", "ext", "language",
        text.unify_newlines(body).alias("content"), ok.alias("decode_ok"), "size_bytes")


def pack_files(files: DataFrame, path: str, partitions: int | None = None,
               mode: str = "overwrite") -> None:
    """Write the ``files`` table, clustered by repository within language.

    Range partitioning on (language, repository, path) keeps a repository's
    files together yet splits a huge one over as many ranges as it needs.
    """
    keys = ["language", "repo_url", "path"]
    ranged = (files.repartitionByRange(*keys) if partitions is None
              else files.repartitionByRange(partitions, *keys))
    ranged.write.mode(mode).partitionBy("language").parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

