"""Contingency tables and the chi-square test of independence.

Tables are long: ``(row_key, col_key, n)``. After the first, partially
combined count the data is as small as rows x columns of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.catalogs import domain
from faultlens.functions import scalars
from faultlens.functions.chi2 import chi2_sf


#: Copies of the column keys among which rows are spread to meet them.
_SALTS = 64


def contingency(data: DataFrame, row: str, col: str, keys=None) -> DataFrame:
    """Observed cells, a zero for every pair of keys that never meets.

    With ``keys``, the column domain, one pass: a conditional count per key.
    Without, pairs are counted once, and the counted rows and columns, however
    many, make the grid that is filled with zeros.
    """
    if keys is None:
        return _observed_grid(data.select(F.col(row).alias("row_key"), F.col(col).alias("col_key")))
    cells = F.array(*[
        F.struct(F.lit(key).alias("col_key"), F.col(f"_{i}").alias("n"))
        for i, key in enumerate(keys)])
    counted = data.where(F.col(row).isNotNull()).groupBy(F.col(row).alias("row_key")).agg(
        *(F.count_if(F.col(col) == key).alias(f"_{i}") for i, key in enumerate(keys)))
    return counted.select("row_key", F.inline(cells))


def _observed_grid(pairs: DataFrame) -> DataFrame:
    counted = pairs.where("row_key IS NOT NULL").groupBy("row_key", "col_key").agg(
        F.count("*").alias("n"))
    rows = counted.select("row_key").distinct().withColumn(
        "_salt", F.pmod(F.hash("row_key"), F.lit(_SALTS)))
    columns = counted.select("col_key").where("col_key IS NOT NULL").distinct().withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    grid = rows.join(columns, "_salt").drop("_salt")
    return grid.join(counted, ["row_key", "col_key"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0)))


def pivoted(data: DataFrame, row: str, col: str, keys) -> DataFrame:
    """Wide form over a known column domain."""
    return data.groupBy(row).agg(
        *(F.count_if(F.col(col) == key).alias(str(key).lower()) for key in keys))


def long_form(wide: DataFrame, row: str, columns) -> DataFrame:
    """Wide counts to long cells."""
    return wide.select(F.col(row), *[F.col(c).cast("bigint") for c in columns]).unpivot(
        [row], list(columns), "col_key", "n").withColumnRenamed(row, "row_key")


def infer_category_columns(columns, categories=domain.CATEGORIES) -> dict[str, str]:
    """Count column per category: exact name if there, else the first that
    contains the category and is no percentage."""
    found = {}
    for category in categories:
        part = "adv" if category == "Advanced" else category.lower()
        named = [c for c in columns if c.strip() == category]
        like = [c for c in columns if part in c.lower() and "%" not in c]
        if named or like:
            found[category] = (named or like)[0]
    return found


def cells_from_counts(wide: DataFrame, row: str = "Language",
                      exclude=(domain.MULTIPLE,)) -> DataFrame:
    """Published wide counts to cells: category columns found by name, text
    coerced to numbers, the multi-language row left out."""
    chosen = infer_category_columns(wide.columns)
    kept = wide.where(F.col(row).isNotNull() & ~F.trim(row).isin(*exclude))
    typed = kept.select(
        F.trim(row).alias("row_key"),
        *(F.trim(F.col(f"`{source}`").cast("string")).try_cast("bigint").alias(category)
          for category, source in chosen.items()))
    return long_form(typed, "row_key", list(chosen))


def with_totals(cells: DataFrame) -> DataFrame:
    """Row, column and grand totals next to every cell.

    Column totals come back through an equi-join, so only the column domain,
    never the rows, passes through a single task. The join's two sides share
    the shuffle that produced the cells.
    """
    per_column = cells.groupBy("col_key").agg(F.sum("n").alias("col_total"))
    per_column = per_column.withColumn(
        "grand_total", F.sum("col_total").over(Window.partitionBy()))
    in_row = cells.withColumn("row_total", F.sum("n").over(Window.partitionBy("row_key")))
    return in_row.join(per_column, "col_key").select(
        *cells.columns, "row_total", "col_total", "grand_total")


def row_totals(cells: DataFrame) -> DataFrame:
    """Total and number of zero cells per row, and of the whole table."""
    return cells.rollup("row_key").agg(
        (F.grouping("row_key") == 1).alias("is_total"),
        F.sum("n").alias("total"), F.count_if(F.col("n") == 0).alias("zero_cells"))


def contributions(cells: DataFrame) -> DataFrame:
    """Expected count and (observed - expected)^2 / expected of every cell."""
    expected = F.try_divide(
        F.col("row_total").cast("double") * F.col("col_total"), F.col("grand_total"))
    out = with_totals(cells).withColumn("expected", expected)
    gap = F.col("n") - F.col("expected")
    return out.withColumn("contribution", F.try_divide(gap * gap, F.col("expected")))


def chi_square(cells: DataFrame, correction: bool = True) -> DataFrame:
    """One row: statistic, degrees of freedom, p-value, Cramer's V and what
    follows from them. With one degree of freedom the continuity correction
    moves every gap up to one half towards zero."""
    gap = F.abs(F.col("n") - F.col("expected"))
    plain = F.try_divide(gap * gap, F.col("expected"))
    moved = gap - F.least(F.lit(0.5), gap)
    return (
        contributions(cells)
        .select("*", plain.alias("_plain"), F.try_divide(moved * moved, F.col("expected")).alias("_moved"))
        .agg(
            F.countDistinct("row_key").alias("n_rows"),
            F.countDistinct("col_key").alias("n_cols"),
            F.sum("n").alias("n"),
            F.sum("_plain").alias("_plain"),
            F.sum("_moved").alias("_moved"),
            F.count("*").alias("cells"),
            F.count_if(F.col("expected") < 5).alias("cells_below_5"),
        )
        .withColumn("dof", (F.col("n_rows") - 1) * (F.col("n_cols") - 1))
        .withColumn("chi2", F.when((F.col("dof") == 1) & F.lit(correction), F.col("_moved"))
                    .otherwise(F.col("_plain")))
        .withColumn("cramers_v", cramers_v())
        .withColumn("below_5_pct", F.try_divide(F.col("cells_below_5") * 100.0, F.col("cells")))
        .select(
            "chi2", "dof", "n", "n_rows", "n_cols", "cramers_v",
            scalars.effect_size(F.col("cramers_v")).alias("effect_size"),
            "cells", "cells_below_5", "below_5_pct",
            (F.col("below_5_pct") <= 20).alias("assumption_ok"),
        )
    )


def cramers_v() -> Column:
    smaller = F.least(F.col("n_rows") - 1, F.col("n_cols") - 1)
    return F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * smaller))


def with_decision(test: DataFrame) -> DataFrame:
    """p-value and the decision at the 0.001 and 0.05 levels."""
    return test.withColumn("p_value", chi2_sf(F.col("chi2"), F.col("dof"))).withColumn(
        "decision", scalars.decision(F.col("p_value")))


def top_contributions(cells: DataFrame, k: int = 10) -> DataFrame:
    """The k cells that add most to the statistic."""
    return contributions(cells).select(
        "row_key", "col_key", "n", "expected", "contribution"
    ).orderBy(F.desc("contribution"), "row_key", "col_key").limit(k)


def row_percentages(cells: DataFrame, rounding: str = "half_up") -> DataFrame:
    """Share of each cell in its row."""
    total = F.sum("n").over(Window.partitionBy("row_key"))
    return cells.select("*", total.alias("row_total")).withColumn(
        "pct", scalars.share(F.col("n"), F.col("row_total"), 2, rounding))


def advanced_mixed_share(cells: DataFrame) -> DataFrame:
    """Advanced plus Mixed share per row, as a sum of rounded shares."""
    wanted = F.when(F.col("col_key").isin("Advanced", "Mixed"), F.col("pct")).otherwise(0.0)
    return row_percentages(cells).groupBy("row_key").agg(
        F.round(F.sum(wanted), 2).alias("advanced_mixed_pct"))


def advanced_mixed_mean(shares: DataFrame) -> DataFrame:
    """Unweighted mean of the shares over rows."""
    return shares.agg(F.avg("advanced_mixed_pct").alias("mean_pct"))


def percent_table(cells: DataFrame, categories=domain.CATEGORIES) -> DataFrame:
    """Wide percent table with the combined Advanced + Mixed column."""
    wide = row_percentages(cells).groupBy("row_key", "row_total").agg(*(
        F.max(F.when(F.col("col_key") == c, F.col("pct"))).alias(f"{c.lower()}_pct")
        for c in categories))
    combined = F.coalesce("mixed_pct", F.lit(0.0)) + F.coalesce("advanced_pct", F.lit(0.0))
    return wide.withColumn("advanced_mixed_pct", F.round(combined, 2))
