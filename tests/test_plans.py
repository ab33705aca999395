"""Physical plans that have to hold at scale."""

import re

import pytest

from faultlens.catalogs import domain
from faultlens.functions import scalars
from faultlens.operators import contingency
from faultlens.operators.signals import classify_files
from faultlens.plans.scan import scan_corpus
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = [("r", f"p{i}", "python", "timeout(1)\n", True, "unused") for i in range(20)]
    spark.createDataFrame(
        rows, "repo_url string, path string, language string, content string, "
              "decode_ok boolean, other string").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_scan_shuffles_partial_rows_only(corpus):
    """One shuffle by repository and unlisted name, one that brings the names to their repository."""
    text = plan(scan_corpus(corpus))
    shuffles = re.findall(r"Exchange (hashpartitioning\([^)]*\))", text)
    assert len(shuffles) == 2 and "_name" not in shuffles[0] and "_name" in shuffles[1]
    for below in text.split("Exchange")[1:]:
        assert re.search(r"Aggregate\(.*functions=\[(?:partial|merge)_", below.splitlines()[1])
    assert "Python" not in text and "Window" not in text
    assert "partial_min_by" in text or "partial_min" in text


def test_only_needed_columns_are_read(corpus):
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan(scan_corpus(corpus))).group(1)
    assert "other" not in schema


def test_language_filter_reaches_the_scan(corpus):
    text = plan(classify_files(corpus).where("language = 'go'"))
    assert "PushedFilters: [IsNotNull(language), EqualTo(language,go)]" in text


def test_label_filter_does_not_repeat_the_patterns(corpus):
    free = plan(classify_files(corpus)).count("RLIKE")
    filtered = plan(classify_files(corpus).where("label = 'Mixed'")).count("RLIKE")
    exploded = plan(classify_files(corpus).select(F.explode("flags"))).count("RLIKE")
    assert filtered == free and exploded <= free


def test_contingency_reads_the_corpus_once(corpus):
    results = scan_corpus(corpus).withColumn(
        "language", scalars.language_group(F.col("languages")))
    cells = contingency.contingency(results, "language", "exception_type", domain.CATEGORIES)
    test = contingency.chi_square(cells)
    test.collect()
    final = test._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in final or "BroadcastExchange" in final


def test_no_cross_joins(spark, corpus):
    results = scan_corpus(corpus)
    cells = contingency.contingency(results, "exception_type", "status", ["ok"])
    for frame in (contingency.chi_square(cells), contingency.top_contributions(cells)):
        assert "CartesianProduct" not in plan(frame)
        assert "BroadcastNestedLoopJoin" not in plan(frame)
