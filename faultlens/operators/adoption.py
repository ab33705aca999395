"""Pattern adoption by language and by single- vs multi-language repositories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.catalogs import domain
from faultlens.functions import scalars
from faultlens.operators.relational import lookup, reorder

# Short names of the six patterns, in report order.
PATTERNS = tuple(
    "backoff" if flag == "exponential_backoff" else flag for flag in domain.CORE_FLAGS)


def pattern_counts(results: DataFrame, group: Column | None = None,
                   patterns=PATTERNS) -> DataFrame:
    """Repositories per language group that show each pattern."""
    group = scalars.language_group(F.col("languages")) if group is None else group
    return results.groupBy(group.alias("language")).agg(
        F.count("*").alias("total_repos"),
        *(F.count_if(F.col(f"has_{p}")).alias(p) for p in patterns),
    ).where(F.col("language").isNotNull())


def with_subtotal(counts: DataFrame, patterns=PATTERNS) -> DataFrame:
    """The same rows plus one computed subtotal over single-language groups,
    marked by ``is_subtotal`` instead of by its name alone."""
    many = F.col("language") == domain.MULTIPLE
    rolled = counts.withColumn("is_multi", many).rollup("is_multi", "language").agg(
        F.grouping("language").alias("_over_languages"),
        F.grouping("is_multi").alias("_over_all"),
        F.sum("total_repos").alias("total_repos"),
        *(F.sum(p).alias(p) for p in patterns),
    )
    # Of the rollup's totals only the single-language one is reported.
    wanted = (F.col("_over_languages") == 0) | ((F.col("_over_all") == 0) & ~F.col("is_multi"))
    return rolled.where(wanted).select(
        F.coalesce("language", F.lit(domain.SUBTOTAL_LABEL)).alias("language"),
        (F.col("_over_languages") == 1).alias("is_subtotal"),
        "total_repos", *patterns)


def drop_subtotal_rows(table: DataFrame, column: str = "language",
                       labels=(domain.SUBTOTAL_LABEL, "NaN", "nan")) -> DataFrame:
    """Blank and in-band subtotal rows out."""
    return table.where(F.col(column).isNotNull() & (F.trim(column) != "")
                       & ~F.col(column).isin(*labels))


def adoption_by_language(counts: DataFrame, totals: DataFrame | None = None,
                         patterns=PATTERNS, rounding: str = "half_up") -> DataFrame:
    """Adoption in percent per language and pattern, in long form. ``totals``
    (language, total_repos) replaces the counts' own denominators; a language
    it does not know gets a null share and ``matched = false``."""
    if totals is not None:
        counts = lookup(counts.drop("total_repos"), totals, "language",
                        normalise=scalars.language_join_key)
        matched = F.col("matched")
    else:
        matched = F.lit(True)
    tall = counts.select("language", matched.alias("matched"), "total_repos", *patterns).unpivot(
        ["language", "matched", "total_repos"], list(patterns), "pattern", "n_repos")
    return tall.withColumn(
        "pct", scalars.share(F.col("n_repos"), F.col("total_repos"), 1, rounding))


def adoption_single_vs_multi(counts: DataFrame, patterns=PATTERNS) -> DataFrame:
    """Weighted adoption of single- and multi-language repositories: shares,
    difference in points and ratio (infinite when single is zero)."""
    many = F.col("language") == domain.MULTIPLE

    def total(column: str, condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(column))), F.lit(0))

    one = counts.agg(
        total("total_repos", ~many).alias("single_repos"),
        total("total_repos", many).alias("multi_repos"),
        *(total(p, ~many).alias(f"single_{p}") for p in patterns),
        *(total(p, many).alias(f"multi_{p}") for p in patterns),
    )
    rows = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(p).alias("pattern"),
                 F.col(f"single_{p}").alias("single_n"), F.col("single_repos"),
                 F.col(f"multi_{p}").alias("multi_n"), F.col("multi_repos"))
        for i, p in enumerate(patterns)
    ])
    single = F.try_divide(F.col("single_n") * 100.0, F.col("single_repos"))
    multi = F.try_divide(F.col("multi_n") * 100.0, F.col("multi_repos"))
    return one.select(F.inline(rows)).select(
        "*", single.alias("single_pct"), multi.alias("multi_pct"),
    ).withColumn("diff_points", F.col("multi_pct") - F.col("single_pct")).withColumn(
        "ratio",
        F.when(F.col("single_pct") > 0, F.col("multi_pct") / F.col("single_pct"))
        .otherwise(F.lit(float("inf"))),
    ).orderBy("ord")


def adoption_mean(comparison: DataFrame) -> DataFrame:
    """Mean adoption over the patterns, difference and relative lift."""
    return comparison.agg(
        F.avg("single_pct").alias("single_mean_pct"),
        F.avg("multi_pct").alias("multi_mean_pct"),
    ).select(
        "*",
        (F.col("multi_mean_pct") - F.col("single_mean_pct")).alias("diff_points"),
        ((F.try_divide("multi_mean_pct", "single_mean_pct") - 1) * 100).alias("lift_pct"),
    )


def patterns_per_repo(counts: DataFrame, patterns=PATTERNS) -> DataFrame:
    """Total patterns, patterns per repository, and the languages' rank."""
    total = reduce(lambda a, b: a + b, [F.col(p) for p in patterns])
    out = counts.select(
        "language", "total_repos", total.alias("total_patterns")
    ).withColumn("patterns_per_repo", F.try_divide("total_patterns", "total_repos"))
    # One row per language: the unpartitioned window orders a handful of rows.
    return out.withColumn(
        "rank", F.rank().over(Window.orderBy(F.desc("patterns_per_repo"))))


def pattern_heatmap(adoption: DataFrame, languages: DataFrame, patterns=PATTERNS) -> DataFrame:
    """Language x pattern shares in a given language order, missing as 0."""
    wide = adoption.groupBy("language").agg(*(
        F.coalesce(F.max(F.when(F.col("pattern") == p, F.col("pct"))), F.lit(0.0)).alias(p)
        for p in patterns))
    return reorder(wide, languages, "language")
