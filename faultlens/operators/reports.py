"""Report tables: typed rows, and their text lines for publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.catalogs import domain
from faultlens.functions import scalars
from faultlens.operators import contingency


def _grouped(n: str) -> Column:
    return F.format_number(F.col(n), 0)


def distribution_lines(distribution: DataFrame) -> DataFrame:
    """``category | count | share`` lines of a category distribution."""
    return distribution.select("ord", F.format_string(
        "%-20s %15s %14.2f%%", F.col("category"), _grouped("n"), F.col("pct")).alias("value"))


def language_lines(cells: DataFrame) -> DataFrame:
    """One line per language: repositories and the four category shares."""
    wide = cells.groupBy("row_key").agg(
        F.sum("n").alias("total"),
        *(F.coalesce(F.sum(F.when(F.col("col_key") == c, F.col("n"))), F.lit(0)).alias(f"_{i}")
          for i, c in enumerate(domain.CATEGORIES)))
    shares = [scalars.share(F.col(f"_{i}"), F.col("total"), 1)
              for i in range(len(domain.CATEGORIES))]
    return wide.select("row_key", F.format_string(
        "%-12s %7s" + " %7.1f%%" * len(shares), F.col("row_key"), _grouped("total"), *shares
    ).alias("value"))


def test_lines(test: DataFrame) -> DataFrame:
    """The chi-square result as labelled lines."""
    texts = (
        F.format_string("Chi-square: %.2f", F.col("chi2")),
        F.format_string("Degrees of freedom: %d", F.col("dof")),
        F.format_string("P-value: %.2e", F.col("p_value")),
        F.format_string("Cramer's V: %.4f (%s)", F.col("cramers_v"), F.col("effect_size")),
        F.concat(F.lit("Decision: "), F.col("decision")),
    )
    lines = F.array(*[F.struct(F.lit(i).alias("ord"), line.alias("value"))
                      for i, line in enumerate(texts)])
    return test.select(F.inline(lines))


def write_lines(lines: DataFrame, path: str, order: str = "ord") -> None:
    """A report is a handful of lines; it is written as one text file."""
    lines.orderBy(order).coalesce(1).select("value").write.mode("overwrite").text(path)


# ------------------------------------------------------------- chart tables
def category_chart(distribution: DataFrame) -> DataFrame:
    return distribution.select("category", "n", "pct")


def language_category_chart(cells: DataFrame, languages: DataFrame) -> DataFrame:
    """Category shares per language, in a given language order."""
    from faultlens.operators.relational import reorder

    table = contingency.percent_table(cells).withColumnRenamed("row_key", "language")
    return reorder(table, languages, "language")


def advanced_mixed_chart(cells: DataFrame) -> DataFrame:
    """Advanced + Mixed share per language with the mean line's value."""
    shares = contingency.advanced_mixed_share(cells)
    mean = contingency.advanced_mixed_mean(shares)
    return shares.withColumn("mean_pct", mean.scalar()).orderBy(F.desc("advanced_mixed_pct"))


def adoption_chart(comparison: DataFrame) -> DataFrame:
    return comparison.select(
        "ord", "pattern", F.round("single_pct", 1).alias("single_pct"),
        F.round("multi_pct", 1).alias("multi_pct"))
