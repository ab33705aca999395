"""Labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def training_texts(
    docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, most: int,
) -> DataFrame:
    """text, label (0 or 1) of at most ``most`` labelled rows outside the held-out fold.

    The rows are those whose ids have the smallest hashes, of the ids that ``docs`` has.
    A doc_id with several labels has the smallest, and one with several rows is
    learnt from the text with the smallest hash; rows without a doc_id or a label
    teach nothing.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("labelled_id"), F.col("text").cast("string"))
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("labelled_id"), F.col(label).cast("int").alias("label"))
        .filter("labelled_id is not null and label in (0, 1)")
        .filter(remainder(F.col("labelled_id"), modulus) != held_out)
        .groupBy("labelled_id").agg(F.min("label").alias("label"))
        .join(rows.select("labelled_id").distinct(), "labelled_id", "left_semi")
        .orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(most)
    )
    # Rows that repeat an id are folded before the shuffle, so that a hot id sends one row per task.
    return rows.join(F.broadcast(chosen), "labelled_id").groupBy("labelled_id").agg(
        F.min_by(F.struct("text", "label"), F.struct(F.xxhash64("text"), "text")).alias("row")
    ).select("row.text", "row.label")
