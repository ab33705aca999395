"""Category distribution over repositories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.catalogs import domain
from faultlens.functions import scalars

_RESIDUAL_ROW = "Mixed"


def category_table(spark, categories=domain.CATEGORIES) -> DataFrame:
    """The fixed label domain with its report order."""
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("category"))
                     for i, c in enumerate(categories)])
    return spark.range(1).select(F.inline(rows))


def split_by_rate(results: DataFrame, rate: str = "rate") -> tuple[DataFrame, DataFrame]:
    """(analysed, failed). A null rate belongs to neither."""
    return results.where(F.col(rate) > 0), results.where(F.col(rate) == 0)


def _counted(labels: DataFrame, label: str, categories) -> DataFrame:
    """One row: rows in all and per category. A single map-side-combined pass,
    and a label nobody has is already there as zero."""
    value = scalars.category_or_none(F.col(label))
    return labels.agg(
        F.count("*").alias("n_rows"),
        *(F.count_if(value == name).alias(f"n_{i}") for i, name in enumerate(categories)),
    )


def _total(categories) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"n_{i}") for i in range(len(categories))])


def _rounded_shares(categories, rounding: str) -> list[Column]:
    """Two-digit shares; the residual goes to one row so that they sum to 100."""
    total = _total(categories)
    shares = [F.coalesce(scalars.share(F.col(f"n_{i}"), total, 2, rounding), F.lit(0.0))
              for i in range(len(categories))]
    residual = F.lit(100.0) - reduce(lambda a, b: a + b, shares)
    return [
        F.when(total > 0, F.round(share + residual, 2)).otherwise(share)
        if name == _RESIDUAL_ROW else share
        for name, share in zip(categories, shares)
    ]


def category_counts(labels: DataFrame, label: str = "exception_type",
                    categories=domain.CATEGORIES) -> DataFrame:
    """Counts over the whole domain, in report order."""
    rows = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(name).alias("category"), F.col(f"n_{i}").alias("n"))
        for i, name in enumerate(categories)
    ])
    return _counted(labels, label, categories).select(F.inline(rows))


def category_distribution(labels: DataFrame, label: str = "exception_type",
                          categories=domain.CATEGORIES, rounding: str = "half_up") -> DataFrame:
    """Counts with exact and rounded shares; rounded shares sum to 100.00."""
    rounded = _rounded_shares(categories, rounding)
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("ord"), F.lit(name).alias("category"), F.col(f"n_{i}").alias("n"),
            F.try_divide(F.col(f"n_{i}") * 100.0, _total(categories)).alias("exact_pct"),
            rounded[i].alias("pct"),
        )
        for i, name in enumerate(categories)
    ])
    return _counted(labels, label, categories).select(F.inline(rows)).orderBy("ord")


def overview(results: DataFrame, rate: str = "rate") -> DataFrame:
    """Analysed and failed totals; null rates are left out of both."""
    return results.agg(
        F.count_if(F.col(rate) > 0).alias("valid"),
        F.count_if(F.col(rate) == 0).alias("failed"),
    ).select(
        (F.col("valid") + F.col("failed")).alias("total"), "valid", "failed",
        scalars.share(F.col("valid"), F.col("valid") + F.col("failed"), 1).alias("valid_pct"),
        scalars.share(F.col("failed"), F.col("valid") + F.col("failed"), 1).alias("failed_pct"),
    )


def derived_totals(labels: DataFrame, label: str = "exception_type") -> DataFrame:
    """With-handling and advanced-or-mixed totals with shares."""
    value = scalars.category_or_none(F.col(label))

    def pct(part: str) -> Column:
        return scalars.share(F.col(part), F.col("total"), 1).alias(f"{part}_pct")

    return labels.agg(
        F.count("*").alias("total"),
        F.count_if(value != "None").alias("with_handling"),
        F.count_if(value == "None").alias("without_handling"),
        F.count_if(value == "Advanced").alias("advanced"),
        F.count_if(value == "Mixed").alias("mixed"),
        F.count_if(value == "Basic").alias("basic"),
        F.count_if(value.isin("Advanced", "Mixed")).alias("advanced_or_mixed"),
    ).select("*", pct("with_handling"), pct("without_handling"), pct("advanced_or_mixed"))


def distribution_check(labels: DataFrame, label: str = "exception_type",
                       fail: bool = False) -> DataFrame:
    """Do the counts cover every row and do the shares sum to 100? With
    ``fail`` a violation raises when the check is read."""
    shares = _rounded_shares(domain.CATEGORIES, "half_up")
    checked = _counted(labels, label, domain.CATEGORIES).select(
        "n_rows", _total(domain.CATEGORIES).alias("n_counted"),
        F.round(reduce(lambda a, b: a + b, shares), 2).alias("pct_sum"),
    ).select(
        "*",
        (F.col("n_rows") == F.col("n_counted")).alias("counts_ok"),
        (F.col("pct_sum") == 100.0).alias("shares_ok"),
    )
    if fail:
        ok = F.col("counts_ok") & F.col("shares_ok")
        checked = checked.withColumn(
            "checked", F.when(ok, True).otherwise(F.raise_error(F.lit("distribution mismatch"))))
    return checked


def run_summary(results: DataFrame, key: str = "repo_url") -> DataFrame:
    """Rows and distinct keys of a result store."""
    per_key = results.groupBy(key).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(key).alias("n_repositories"))
