"""The driver's tables bound to the library's data model.

There is no source code among them, so files are made of documents: every
document's whole text becomes the commented part of one source file, between
two code pieces chosen from the document's own numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.catalogs import domain
from faultlens.catalogs.signals import Rule
from faultlens.functions.text import sql_text
from faultlens.plans.workload.snippets import BODIES, HEADS

N_HEADS = 4
N_BODIES = 6
DOCUMENT_LANGUAGES = ("en", "fr", "de", "es")
# Languages there are code pieces for; PHP has rules but no routed extension.
WRITTEN = domain.LANGUAGES + ("php",)
EXTENSION = {**{language: ext for ext, language in domain.EXTENSION_LANGUAGE.items()},
             "php": ".php"}
COMMENT = {language: "#" if language in ("python", "ruby") else "//" for language in WRITTEN}

# Surrogate rules: tokens that occur in the documents stand in for code signals.
SURROGATE_RULES = (
    Rule("surrogate.try", "*", "raw", "(?i)license", "basic", ("try_catch",)),
    Rule("surrogate.status", "*", "raw", "@[A-Za-z]", "basic", ("status_check",)),
    Rule("surrogate.timeout", "*", "raw", "token = ", "advanced", ("timeout",)),
    Rule("surrogate.retry", "*", "raw", "[%#*$&]{3}", "advanced", ("retry",)),
    Rule("surrogate.breaker", "*", "raw", "[|]", "advanced", ("circuit_breaker",)),
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of repositories (``source``)."""
    return as_files(documents(spark, sf_dir))


def as_files(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("source").alias("repo_url"),
        F.format_string("%012d", "doc_id").alias("path"),
        F.col("lang").alias("language"),
        F.col("text").alias("content"),
        F.lit(True).alias("decode_ok"),
        "doc_id",
    )


def _array(items) -> str:
    return "array(" + ", ".join(items) + ")"


def _pick(table: dict, language: Column, index: Column) -> Column:
    pieces = _array(_array(map(sql_text, table[name])) for name in WRITTEN)
    return F.element_at(F.element_at(F.expr(pieces), language + 1), index + 1)


def source_files(spark: SparkSession, sf_dir: str, language: str | None = None) -> DataFrame:
    """Every document as a source file: of ``language``, or of each in turn."""
    number = (F.col("doc_id") % len(domain.LANGUAGES)).cast("int") if language is None \
        else F.lit(WRITTEN.index(language))

    def of_language(values) -> Column:
        return F.element_at(F.expr(_array(map(sql_text, values))), number + 1)

    name = of_language(WRITTEN)
    ext = of_language(EXTENSION[n] for n in WRITTEN)
    mark = of_language(COMMENT[n] for n in WRITTEN)
    head = _pick(HEADS, number, (F.col("n_chars") % N_HEADS).cast("int"))
    body = _pick(BODIES, number, (F.floor(F.col("doc_id") / 9) % N_BODIES).cast("int"))
    remark = F.concat(mark, F.lit(" "),
                      F.replace(F.col("text"), F.lit("\n"), F.concat(F.lit("\n"), mark)))
    repo = F.when(F.col("lang") == "en", F.col("source")).otherwise(
        F.concat_ws("-", "source", name))
    return documents(spark, sf_dir).select(
        "doc_id",
        F.concat(F.lit("https://example.com/corpus/"), repo).alias("repo_url"),
        F.concat(F.lit("src/"), F.format_string("%012d", "doc_id"), ext).alias("path"),
        name.alias("language"),
        F.concat(head, remark, F.lit("\n"), body).alias("content"),
        F.lit(True).alias("decode_ok"),
    )


def event_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as labelled files: a user is a repository."""
    kind = F.col("event_type")
    label = (
        F.when(kind == "view", "None").when(kind.isin("click", "signup"), "Basic")
        .when(kind == "purchase", "Advanced").when(kind == "error", "Mixed")
    )
    return load(spark, sf_dir, "events").select(
        "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id",
        "event_type", label.alias("label"), "props", "value")


def page_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a page as the import paths of a file."""
    return pages(spark, sf_dir).select(
        "page_id",
        F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("language"),
        F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1)).alias("paths"))


def page_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as repositories: links are libraries."""
    return page_imports(spark, sf_dir).select(
        F.col("page_id").cast("string").alias("repo_url"),
        F.array_distinct("paths").alias("http_libraries"),
        F.array("language").alias("languages"))


def benchmark_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lower-case words of the benchmark texts as catalog patterns."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))
    return load(spark, sf_dir, "benchmark").select(
        F.explode(words).alias("pattern")).distinct()


def customer_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with region and market segment; nation and region are joined
    by key and Spark decides how."""
    return (
        load(spark, sf_dir, "customer")
        .join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment"))
    )
