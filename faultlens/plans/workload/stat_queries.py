"""Distributions, contingency tables and the chi-square test."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.functions import scalars
from faultlens.operators import contingency, distribution, relational, reports
from faultlens.operators.rollup import fold_labels, fold_labels_any
from faultlens.plans.workload import tables
from faultlens.plans.workload.registry import query

_LABELS = """labels_of AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day, CASE event_type
    WHEN 'view' THEN 'None' WHEN 'click' THEN 'Basic' WHEN 'signup' THEN 'Basic'
    WHEN 'purchase' THEN 'Advanced' WHEN 'error' THEN 'Mixed' END AS label FROM events)"""


@query("repo_fold", f"""WITH {_LABELS}, f AS (SELECT user_id, day,
    arg_min(label, event_id) FILTER (label <> 'None') AS first_label,
    bool_or(label = 'Basic') AS b, bool_or(label = 'Advanced') AS a
  FROM labels_of GROUP BY ALL)
SELECT user_id, day, CASE WHEN first_label IS NULL THEN 'None' WHEN a AND b THEN 'Mixed'
  ELSE first_label END AS exception_type FROM f""")
def repo_fold(spark, sf_dir):
    return fold_labels(tables.event_labels(spark, sf_dir), ["user_id", "day"], "event_id")


@query("repo_fold_any", f"""WITH {_LABELS}, f AS (SELECT user_id, day,
    bool_or(label IN ('Basic', 'Mixed')) AS b, bool_or(label IN ('Advanced', 'Mixed')) AS a
  FROM labels_of GROUP BY ALL)
SELECT user_id, day, CASE WHEN a AND b THEN 'Mixed' WHEN a THEN 'Advanced' WHEN b THEN 'Basic'
  ELSE 'None' END AS exception_type FROM f""")
def repo_fold_any(spark, sf_dir):
    return fold_labels_any(tables.event_labels(spark, sf_dir), ["user_id", "day"])


_COUNTED = _LABELS + """,
c(ord, category) AS (VALUES (0, 'None'), (1, 'Basic'), (2, 'Mixed'), (3, 'Advanced')),
n AS (SELECT ord, category, (SELECT count(*) FROM labels_of WHERE label = category) AS n FROM c),
r AS (SELECT *, n * 100.0::DOUBLE / sum(n) OVER () AS exact_pct,
  round(n * 100.0::DOUBLE / sum(n) OVER (), 2) AS rounded FROM n),
dist AS (SELECT ord, category, n, round(exact_pct, 6) AS exact_pct,
  CASE category WHEN 'Mixed' THEN round(rounded + 100.0 - sum(rounded) OVER (), 2)
    ELSE rounded END AS pct FROM r)"""


@query("category_distribution", f"WITH {_COUNTED} SELECT * FROM dist")
def category_distribution(spark, sf_dir):
    return distribution.category_distribution(
        tables.event_labels(spark, sf_dir), "label"
    ).withColumn("exact_pct", F.round("exact_pct", 6))


@query("category_chart", f"WITH {_COUNTED} SELECT category, n, pct FROM dist")
def category_chart(spark, sf_dir):
    return reports.category_chart(
        distribution.category_distribution(tables.event_labels(spark, sf_dir), "label"))


@query("distribution_report_lines", f"""WITH {_COUNTED} SELECT ord,
  printf('%-20s %15s %14.2f%%', category, format('{{:,}}', n), pct) AS value FROM dist""")
def distribution_report_lines(spark, sf_dir):
    return reports.distribution_lines(
        distribution.category_distribution(tables.event_labels(spark, sf_dir), "label"))


@query("zero_fill", """WITH c(ord, category) AS (VALUES (0, 'None'), (1, 'Basic'), (2, 'Mixed'),
  (3, 'Advanced'))
SELECT ord, category, count(event_id) AS n FROM c LEFT JOIN events e ON
  CASE e.event_type WHEN 'view' THEN 'None' WHEN 'error' THEN 'Mixed' END = c.category
GROUP BY ALL""")
def zero_fill(spark, sf_dir):
    kind = F.col("event_type")
    counts = tables.load(spark, sf_dir, "events").select(
        F.when(kind == "view", "None").when(kind == "error", "Mixed").alias("category")
    ).where("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("n"))
    return relational.zero_fill(counts, distribution.category_table(spark), "category").select(
        "ord", "category", "n")


@query("derived_totals", f"""WITH {_LABELS}, t AS (SELECT count(*) AS total,
    count(*) FILTER (label <> 'None') AS with_handling,
    count(*) FILTER (label = 'None') AS without_handling,
    count(*) FILTER (label = 'Advanced') AS advanced, count(*) FILTER (label = 'Mixed') AS mixed,
    count(*) FILTER (label = 'Basic') AS basic,
    count(*) FILTER (label IN ('Advanced', 'Mixed')) AS advanced_or_mixed FROM labels_of)
SELECT *, round(100.0::DOUBLE * with_handling / total, 1) AS with_handling_pct,
  round(100.0::DOUBLE * without_handling / total, 1) AS without_handling_pct,
  round(100.0::DOUBLE * advanced_or_mixed / total, 1) AS advanced_or_mixed_pct FROM t""")
def derived_totals(spark, sf_dir):
    return distribution.derived_totals(tables.event_labels(spark, sf_dir), "label")


@query("distribution_check", f"""WITH {_COUNTED}
SELECT (SELECT count(*) FROM events) AS n_rows, CAST(sum(n) AS BIGINT) AS n_counted,
  round(sum(pct), 2) AS pct_sum, (SELECT count(*) FROM events) = sum(n) AS counts_ok,
  round(sum(pct), 2) = 100.0 AS shares_ok FROM dist""")
def distribution_check(spark, sf_dir):
    return distribution.distribution_check(tables.event_labels(spark, sf_dir), "label")


@query("run_summary", """SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_repositories
FROM events""")
def run_summary(spark, sf_dir):
    return distribution.run_summary(tables.load(spark, sf_dir, "events"), "user_id")


_RATES = """rates AS (SELECT doc_id, lang, CASE WHEN n_chars % 7 = 0 THEN lang
    ELSE printf('%.2f%%', (n_chars % 50) / 50.0::DOUBLE * 100) END AS success FROM documents)"""


def _rates(spark, sf_dir):
    rate = (F.col("n_chars") % 50) / F.lit(50.0)
    return tables.load(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.when(F.col("n_chars") % 7 == 0, F.col("lang"))
        .otherwise(scalars.format_rate(rate)).alias("success"))


@query("success_rate_parse", f"""WITH {_RATES}
SELECT doc_id, success, TRY_CAST(rtrim(success, '%') AS DOUBLE) AS rate FROM rates""")
def success_rate_parse(spark, sf_dir):
    return _rates(spark, sf_dir).select(
        "doc_id", "success", scalars.parse_rate(F.col("success")).alias("rate"))


@query("rate_overview", f"""WITH {_RATES},
p AS (SELECT TRY_CAST(rtrim(success, '%') AS DOUBLE) AS rate FROM rates),
t AS (SELECT count(*) FILTER (rate > 0) AS valid, count(*) FILTER (rate = 0) AS failed FROM p)
SELECT valid + failed AS total, valid, failed,
  round(100.0::DOUBLE * valid / (valid + failed), 1) AS valid_pct,
  round(100.0::DOUBLE * failed / (valid + failed), 1) AS failed_pct FROM t""")
def rate_overview(spark, sf_dir):
    parsed = _rates(spark, sf_dir).withColumn("rate", scalars.parse_rate(F.col("success")))
    return distribution.overview(parsed)


@query("union_valid_failed", f"""WITH {_RATES},
p AS (SELECT lang, TRY_CAST(rtrim(success, '%') AS DOUBLE) AS rate FROM rates)
SELECT lang, count(*) FILTER (rate > 0) AS valid, count(*) FILTER (rate = 0) AS failed FROM p
WHERE rate IS NOT NULL GROUP BY lang""")
def union_valid_failed(spark, sf_dir):
    parsed = _rates(spark, sf_dir).withColumn("rate", scalars.parse_rate(F.col("success")))
    valid, failed = distribution.split_by_rate(parsed)
    tagged = valid.withColumn("ok", F.lit(True)).unionByName(
        failed.withColumn("ok", F.lit(False)))
    return tagged.groupBy("lang").agg(
        F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("failed"))


# ---------------------------------------------------------------- contingency
_CUSTOMERS = """cells AS (
  SELECT r.row_key, c.col_key, count(k.region) AS n
  FROM (SELECT DISTINCT r_name AS row_key FROM region JOIN nation ON n_regionkey = r_regionkey
        JOIN customer ON c_nationkey = n_nationkey) r
  CROSS JOIN (SELECT DISTINCT c_mktsegment AS col_key FROM customer) c
  LEFT JOIN (SELECT r_name AS region, c_mktsegment AS segment FROM customer
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) k
    ON k.region = r.row_key AND k.segment = c.col_key GROUP BY ALL)"""
_LINES = """cells AS (
  SELECT r.row_key, c.col_key, count(l.l_orderkey) AS n
  FROM (SELECT DISTINCT l_returnflag AS row_key FROM lineitem) r
  CROSS JOIN (SELECT DISTINCT l_linestatus AS col_key FROM lineitem) c
  LEFT JOIN lineitem l ON l_returnflag = row_key AND l_linestatus = col_key GROUP BY ALL)"""
_TEST = """,
t AS (SELECT *, sum(n) OVER (PARTITION BY row_key) AS row_total,
  sum(n) OVER (PARTITION BY col_key) AS col_total, sum(n) OVER () AS grand_total FROM cells),
e AS (SELECT *, row_total::DOUBLE * col_total / grand_total AS expected FROM t),
x AS (SELECT *, (n - expected) * (n - expected) / expected AS contribution FROM e),
test AS (SELECT sum(contribution) AS chi2, (count(DISTINCT row_key) - 1)
    * (count(DISTINCT col_key) - 1) AS dof, sum(n) AS n,
  count(DISTINCT row_key) AS n_rows, count(DISTINCT col_key) AS n_cols, count(*) AS cells,
  count(*) FILTER (expected < 5) AS cells_below_5 FROM x)"""
_V = "sqrt(chi2 / (n * least(n_rows - 1, n_cols - 1)))"


def _customer_cells(spark, sf_dir):
    return contingency.contingency(tables.customer_regions(spark, sf_dir), "region", "segment")


def _line_cells(spark, sf_dir):
    return contingency.contingency(
        tables.load(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query("contingency", f"WITH {_CUSTOMERS} SELECT * FROM cells")
def contingency_table(spark, sf_dir):
    return _customer_cells(spark, sf_dir)


@query("contingency_orders", """SELECT s.row_key, p.col_key, count(o.o_orderkey) AS n
FROM (SELECT DISTINCT o_orderstatus AS row_key FROM orders) s
CROSS JOIN (SELECT DISTINCT o_orderpriority AS col_key FROM orders) p
LEFT JOIN orders o ON o_orderstatus = row_key AND o_orderpriority = col_key GROUP BY ALL""")
def contingency_orders(spark, sf_dir):
    return contingency.contingency(
        tables.load(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query("row_totals", f"""WITH {_CUSTOMERS} SELECT row_key, false AS is_total,
  CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (n = 0) AS zero_cells FROM cells GROUP BY 1
UNION ALL SELECT NULL, true, CAST(sum(n) AS BIGINT), count(*) FILTER (n = 0) FROM cells""")
def row_totals(spark, sf_dir):
    return contingency.row_totals(_customer_cells(spark, sf_dir))


@query("expected_counts", f"""WITH {_CUSTOMERS}{_TEST} SELECT row_key, col_key, n,
  CAST(row_total AS BIGINT) AS row_total, CAST(col_total AS BIGINT) AS col_total,
  CAST(grand_total AS BIGINT) AS grand_total, round(expected, 6) AS expected,
  round(contribution, 6) AS contribution FROM x""")
def expected_counts(spark, sf_dir):
    out = contingency.contributions(_customer_cells(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("expected", "contribution")})


@query("chi_square", f"""WITH {_CUSTOMERS}{_TEST} SELECT round(chi2, 6) AS chi2, dof,
  CAST(n AS BIGINT) AS n FROM test""")
def chi_square(spark, sf_dir):
    return contingency.chi_square(_customer_cells(spark, sf_dir)).select(
        F.round("chi2", 6).alias("chi2"), "dof", "n")


@query("chi_square_lineitem", f"""WITH {_LINES}{_TEST} SELECT round(chi2, 6) AS chi2, dof,
  CAST(n AS BIGINT) AS n, round({_V}, 6) AS cramers_v FROM test""")
def chi_square_lineitem(spark, sf_dir):
    return contingency.chi_square(_line_cells(spark, sf_dir)).select(
        F.round("chi2", 6).alias("chi2"), "dof", "n", F.round("cramers_v", 6).alias("cramers_v"))


@query("chi_square_two_by_two", """WITH k AS (SELECT n_regionkey < 2 AS r,
    c_mktsegment < 'C' AS c FROM customer JOIN nation ON c_nationkey = n_nationkey),
x AS (SELECT count(*) FILTER (r AND c)::DOUBLE AS a, count(*) FILTER (r AND NOT c)::DOUBLE AS b,
  count(*) FILTER (NOT r AND c)::DOUBLE AS d, count(*) FILTER (NOT r AND NOT c)::DOUBLE AS e
  FROM k),
g AS (SELECT *, a + b + d + e AS n, abs(a - (a + b) * (a + d) / (a + b + d + e)) AS gap FROM x)
SELECT round((gap - least(0.5, gap)) ** 2 * n ** 3 / ((a + b) * (d + e) * (a + d) * (b + e)), 6)
  AS chi2, 1::BIGINT AS dof FROM g""")
def chi_square_two_by_two(spark, sf_dir):
    """One degree of freedom: the continuity correction applies."""
    data = tables.load(spark, sf_dir, "customer").join(
        tables.load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select((F.col("n_regionkey") < 2).alias("r"), (F.col("c_mktsegment") < "C").alias("c"))
    return contingency.chi_square(contingency.contingency(data, "r", "c")).select(
        F.round("chi2", 6).alias("chi2"), "dof")


@query("cramers_v", f"""WITH {_CUSTOMERS}{_TEST} SELECT round({_V}, 6) AS cramers_v,
  CASE WHEN {_V} < 0.1 THEN 'negligible' WHEN {_V} < 0.3 THEN 'small to medium'
    WHEN {_V} < 0.5 THEN 'medium to large' ELSE 'large' END AS effect_size FROM test""")
def cramers_v(spark, sf_dir):
    return contingency.chi_square(_customer_cells(spark, sf_dir)).select(
        F.round("cramers_v", 6).alias("cramers_v"), "effect_size")


@query("chi_assumption", f"""WITH {_CUSTOMERS}{_TEST} SELECT cells, cells_below_5,
  100.0::DOUBLE * cells_below_5 / cells AS below_5_pct,
  100.0 * cells_below_5 / cells <= 20 AS assumption_ok FROM test""")
def chi_assumption(spark, sf_dir):
    return contingency.chi_square(_customer_cells(spark, sf_dir)).select(
        "cells", "cells_below_5", "below_5_pct", "assumption_ok")


# The table is 5 x 5: with 16 degrees of freedom the tail is a finite sum.
@query("chi_decision", f"""WITH {_CUSTOMERS}{_TEST},
p AS (SELECT exp(-chi2 / 2) * list_sum(list_transform(range(dof // 2),
  lambda i: (chi2 / 2) ** i / gamma(i + 1))) AS p_value FROM test)
SELECT round(p_value, 6) AS p_value, CASE WHEN p_value < 0.001 THEN 'highly significant'
  WHEN p_value < 0.05 THEN 'significant' ELSE 'not significant' END AS decision FROM p""")
def chi_decision(spark, sf_dir):
    test = contingency.with_decision(contingency.chi_square(_customer_cells(spark, sf_dir)))
    return test.select(F.round("p_value", 6).alias("p_value"), "decision")


@query("test_report_lines", f"""WITH {_CUSTOMERS}{_TEST},
p AS (SELECT *, exp(-chi2 / 2) * list_sum(list_transform(range(dof // 2),
  lambda i: (chi2 / 2) ** i / gamma(i + 1))) AS p_value, {_V} AS v FROM test),
l AS (SELECT unnest([
  {{'ord': 0, 'value': printf('Chi-square: %.2f', chi2)}},
  {{'ord': 1, 'value': printf('Degrees of freedom: %d', dof)}},
  {{'ord': 2, 'value': printf('P-value: %.2e', p_value)}},
  {{'ord': 3, 'value': printf('Cramer''s V: %.4f (', v) || CASE WHEN v < 0.1 THEN 'negligible'
    WHEN v < 0.3 THEN 'small to medium' WHEN v < 0.5 THEN 'medium to large' ELSE 'large' END || ')'}},
  {{'ord': 4, 'value': 'Decision: ' || CASE WHEN p_value < 0.001 THEN 'highly significant'
    WHEN p_value < 0.05 THEN 'significant' ELSE 'not significant' END}}], recursive := true) FROM p)
SELECT ord, value FROM l""")
def test_report_lines(spark, sf_dir):
    test = contingency.with_decision(contingency.chi_square(_customer_cells(spark, sf_dir)))
    return reports.test_lines(test)


@query("chi_contrib_top10", f"""WITH {_CUSTOMERS}{_TEST} SELECT row_key, col_key, n,
  round(expected, 6) AS expected, round(contribution, 6) AS contribution
FROM x ORDER BY x.contribution DESC, row_key, col_key LIMIT 10""")
def chi_contrib_top10(spark, sf_dir):
    out = contingency.top_contributions(_customer_cells(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("expected", "contribution")})
