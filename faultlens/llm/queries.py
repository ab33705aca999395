"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.llm import (
    factor_machine, kneser_ney, line_field, merkle, mixing, packing, pieces, planes, simhash, spotsigs, sql,
    topk, turn_trie, url_reputation,
)
from faultlens.llm.labelled import remainder


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(
        _table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), size=1024, end_id=2)


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.whole_vectors(_table(spark, sf_dir, "embeddings"), scale=1024)
    return topk.search(vectors, F.col("vec_id") % 100 == 0, k=10)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(
        _table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most_repeats=2.0,
    ).select("doc_id", "size", "source_size", "target", "taken")


def _scored(docs: DataFrame, score, modulus: int, held_out: int, threshold: float) -> DataFrame:
    return (
        docs.select("doc_id", (remainder(F.col("doc_id"), modulus) == held_out).alias("held_out"),
                    score(F.col("text")).alias("score"))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    field = line_field.fit(docs, _table(spark, sf_dir, "labels"), modulus=4, held_out=2)
    return _scored(docs, line_field.scorer(field), 4, 2, 0.7)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    machine = factor_machine.fit(docs, _table(spark, sf_dir, "labels"), modulus=5, held_out=0)
    return _scored(docs, factor_machine.scorer(machine), 5, 0, 0.5)


def op6_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.round_trip(
        _table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edit_report(_table(spark, sf_dir, "documents"))


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 7) == 2
    model = kneser_ney.count(docs.filter(~held_out), order=kneser_ney.ORDER)
    return kneser_ney.score(docs, model, held_out)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def page_outcomes(labels: DataFrame) -> DataFrame:
    """A labelled page is good if its quality is and it is not toxic."""
    return labels.select(
        F.col("doc_id").alias("page_id"),
        ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int").alias("good"))


def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge(
        _table(spark, sf_dir, "pages"), page_outcomes(_table(spark, sf_dir, "labels")))


def op11_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.conversation_trie(_table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def op13_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f for f in (
        op1_best_fit_packing, op2_exact_topk, op3_source_mix, op4_line_quality, op5_toxicity,
        op6_token_planes, op7_spotsigs, op8_kneser_ney, op9_simhash, op10_url_reputation,
        op11_turn_trie, op12_merkle_manifest, op13_piece_round_trip)
}

ORACLE = {
    "op3_source_mix": mixing.REPORT_SQL,
    "op11_turn_trie": sql.TRIE,
    "op12_merkle_manifest": sql.MANIFEST,
}
