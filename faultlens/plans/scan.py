"""End-to-end plans: files to repository rows, repository rows to the study."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.catalogs import domain
from faultlens.functions import scalars
from faultlens.operators import adoption, contingency, distribution, libraries
from faultlens.operators.rollup import repo_results, with_empty_repositories
from faultlens.operators.signals import classify_files
from faultlens.sources.tables import append_results, load_results


def scan_corpus(files: DataFrame, repositories: DataFrame | None = None, *,
                fold: str = "ordered", mode: str = "fixed", **classify) -> DataFrame:
    """Files to one row per repository: one scan, shuffles of partial rows only.

    With ``repositories``, those without a supported file are added as
    ``no_files`` rows.
    """
    signals = classify_files(files, mode=mode, **classify)
    results = repo_results(signals, fold=fold, canonical=mode != "parity")
    return results if repositories is None else with_empty_repositories(results, repositories)


def scan_and_store(files: DataFrame, store: str, batch_id: int = 0, **options) -> DataFrame:
    """Scan, write, and continue from the written rows: everything after reads
    the small result table and never repeats the scan."""
    append_results(scan_corpus(files, **options), store, batch_id)
    return load_results(files.sparkSession, store)


def study(results: DataFrame) -> dict[str, DataFrame]:
    """Every published statistic from a stored result table."""
    valid = results.where(F.col("parser_success_rate") > 0)
    grouped = valid.withColumn("language", scalars.language_group(F.col("languages")))
    cells = contingency.contingency(grouped, "language", "exception_type", domain.CATEGORIES)
    single = contingency.contingency(
        grouped.where(F.col("language") != domain.MULTIPLE), "language", "exception_type",
        domain.CATEGORIES)
    counts = adoption.pattern_counts(valid)
    comparison = adoption.adoption_single_vs_multi(counts)
    catalog = libraries.library_catalog(results)
    return {
        "overview": distribution.overview(results, "parser_success_rate"),
        "distribution": distribution.category_distribution(valid),
        "derived_totals": distribution.derived_totals(valid),
        "contingency": cells,
        "percentages": contingency.percent_table(cells),
        "test": contingency.with_decision(contingency.chi_square(single)),
        "contributions": contingency.top_contributions(single),
        "adoption": adoption.adoption_by_language(counts),
        "adoption_with_subtotal": adoption.with_subtotal(counts),
        "single_vs_multi": comparison,
        "adoption_mean": adoption.adoption_mean(comparison),
        "patterns_per_repo": adoption.patterns_per_repo(counts),
        "libraries": libraries.catalog_order(catalog),
        "library_coverage": libraries.library_coverage(results),
        "library_languages": libraries.top_languages(libraries.language_cooccurrence(results)),
    }



