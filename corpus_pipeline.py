"""From documents to packed training sequences: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns
of ``documents``. Classifiers learn from the documents that they are given and from
the table ``labels``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.llm import factor_machine, line_field, mixing, packing, simhash
from faultlens.llm.queries import vocabulary
from faultlens.llm.storage import written

#: A document stays if its quality is at least, and its toxicity below.
QUALITY, TOXICITY = 0.7, 0.5


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality the line classifier accepts."""
    score = line_field.scorer(line_field.fit(docs, _labels(spark, sf_dir)))
    return docs.filter(score(F.col("text")) >= QUALITY)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not find toxic."""
    score = factor_machine.scorer(factor_machine.fit(docs, _labels(spark, sf_dir)))
    return docs.filter(score(F.col("text")) < TOXICITY)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that with the smallest doc_id."""
    return simhash.keep_one(docs, shingle=4, radius=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources reach their target weights."""
    return mixing.mix(docs, weights=(5, 2, 1), share=1.5, most_repeats=2.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in the packed sequences."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), size=1024, end_id=2)


STAGES = [
    ("quality classifier", keep_good),
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack),
]

#: The classifiers, the fingerprints and the tokenizer have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
