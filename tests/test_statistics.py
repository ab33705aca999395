"""Published statistics from published counts."""

import math

import pytest
from pyspark.sql import functions as F

from faultlens.functions import scalars
from faultlens.functions.chi2 import chi2_sf, log_gamma
from faultlens.operators import adoption, contingency, distribution, reports

# Published counts: repositories per language and label.
COUNTS = [
    ("Python", 2399, 659, 1541, 196, 3), ("Java", 301, 65, 90, 134, 12),
    ("JavaScript", 6320, 1031, 1908, 3075, 306), ("TypeScript", 386, 53, 91, 217, 25),
    ("Go", 147, 0, 141, 5, 1), ("C#", 86, 12, 51, 17, 6), ("Ruby", 164, 1, 6, 138, 19),
    ("Kotlin", 146, 10, 6, 78, 52), ("Swift", 107, 1, 39, 64, 3),
    ("Multiple", 6820, 798, 1630, 4229, 163),
]
# Published counts: repositories per language that show a pattern.
PATTERNS = [
    ("Python", 1735, 42, 236, 0, 0, 452), ("Java", 123, 75, 106, 2, 0, 123),
    ("Javascript", 3753, 3825, 166, 357, 26, 2906), ("TypeScript", 246, 258, 134, 19, 10, 51),
    ("Go", 0, 83, 1, 0, 1, 12), ("C#", 63, 11, 9, 1, 0, 49), ("Ruby", 0, 145, 133, 0, 0, 140),
    ("Kotlin", 100, 130, 31, 0, 3, 25), ("Swift", 0, 77, 45, 0, 8, 46),
    ("Single-Repo Total", 6020, 4646, 861, 379, 48, 3804), (None,) + (None,) * 6,
    ("Multiple", 5410, 4108, 2448, 1102, 324, 4594),
]


@pytest.fixture(scope="module")
def wide(spark):
    rows = [tuple(map(str, r)) for r in COUNTS]
    return spark.createDataFrame(
        rows, ["Language", "Repositories", "None ", "Basic", "Mixed ", "Advanced "])


@pytest.fixture(scope="module")
def cells(wide):
    return contingency.cells_from_counts(wide).cache()


@pytest.fixture(scope="module")
def counts(spark):
    table = spark.createDataFrame(
        PATTERNS, "language string, " + ", ".join(f"{p} int" for p in adoption.PATTERNS))
    totals = spark.createDataFrame([(r[0].lower(), r[1]) for r in COUNTS],
                                   "language string, total_repos int")
    kept = adoption.drop_subtotal_rows(table)
    assert kept.count() == 10
    return kept, totals


def test_chi_square(cells):
    test = contingency.with_decision(contingency.chi_square(cells)).first()
    assert (test["dof"], test["n"], test["cells"], test["cells_below_5"]) == (24, 10056, 36, 2)
    assert test["chi2"] == pytest.approx(2400.6274, abs=1e-4)
    assert test["cramers_v"] == pytest.approx(0.28209, abs=1e-5)
    assert (test["effect_size"], test["decision"]) == ("small to medium", "highly significant")
    assert test["assumption_ok"] and test["p_value"] == 0.0


def test_top_contributions(cells):
    top = contingency.top_contributions(cells).collect()
    assert len(top) == 10
    assert [(r["row_key"], r["col_key"]) for r in top[:3]] == [
        ("Python", "Mixed"), ("Python", "Basic"), ("Kotlin", "Advanced")]
    assert [round(r["contribution"], 3) for r in top[:3]] == [585.163, 412.075, 338.365]
    assert (top[0]["n"], round(top[0]["expected"], 3)) == (196, 936.125)


def test_continuity_correction(spark):
    rows = [("a", "x", 10), ("a", "y", 20), ("b", "x", 30), ("b", "y", 5)]
    two = spark.createDataFrame(rows, "row_key string, col_key string, n bigint")
    gap = abs(10 - 30 * 40 / 65)
    by_hand = lambda g: g * g * sum(65 / (r * c) for r in (30, 35) for c in (40, 25))
    assert contingency.chi_square(two).first()["chi2"] == pytest.approx(by_hand(gap - 0.5))
    assert contingency.chi_square(two, correction=False).first()["chi2"] == pytest.approx(
        by_hand(gap))


def chi2_tail(statistic, dof):
    """A finite sum for whole degrees of freedom, seeded by ``erfc`` when odd."""
    x = statistic / 2.0
    tail, a = (math.erfc(math.sqrt(x)), 0.5) if dof % 2 else (math.exp(-x), 1.0)
    while a < dof / 2.0:
        tail += math.exp(a * math.log(x) - x - math.lgamma(a + 1.0))
        a += 1.0
    return tail


def test_tail_probabilities(spark):
    # Textbook quantiles.
    given = [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (18.307038, 10, 0.05),
             (36.415029, 24, 0.05), (10.827566, 1, 0.001)]
    given += [(x * dof, dof, chi2_tail(x * dof, dof)) for dof in (1, 2, 3, 7, 24, 101, 1000, 5001)
              for x in (0.01, 0.5, 0.9, 1.0, 1.01, 1.2, 3.0)]
    odd = [(0.0, 4, 1.0), (-1.0, 4, 1.0), (1e5, 3, 0.0), (5.0, 0, 1.0), (float("inf"), 3, 0.0),
           (None, 3, None), (1.0, None, None), (float("nan"), 3, None)]
    rows = spark.createDataFrame([(i, x, d) for i, (x, d, _) in enumerate(given + odd)], "i int, x double, d bigint")
    frame = rows.select("i", chi2_sf(F.col("x"), F.col("d")).alias("p"))
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()
    found = {r.i: r.p for r in frame.collect()}
    for i, (x, dof, p) in enumerate(given + odd):
        expected = pytest.approx(p, rel=2e-5 if i < 6 else 1e-9, abs=1e-13) if p is not None else None
        assert found[i] == expected, (x, dof)


def test_log_gamma(spark):
    values = [0.5, 1.0, 1.5, 2.0, 3.7, 12.0, 99.5, 1e4, 1e7]
    found = spark.createDataFrame([(v,) for v in values], "v double").select("v", log_gamma(F.col("v"))).collect()
    for v, got in found:
        assert got == pytest.approx(math.lgamma(v), rel=1e-12, abs=1e-12)


def test_percentages_and_mean(cells, spark):
    shares = contingency.advanced_mixed_share(cells)
    mean = contingency.advanced_mixed_mean(shares).first()[0]
    assert mean == pytest.approx(50.137, abs=5e-3)
    table = {r["row_key"]: r for r in contingency.percent_table(cells).collect()}
    assert (table["Java"]["none_pct"], table["Go"]["none_pct"]) == (21.59, 0.0)
    assert table["Kotlin"]["advanced_mixed_pct"] == pytest.approx(89.04, abs=0.011)
    lines = [r["value"] for r in reports.language_lines(cells).collect()]
    assert any(line.split() == ["Python", "2,399", "27.5%", "64.2%", "8.2%", "0.1%"]
               for line in lines)


def test_contingency_from_rows_has_zero_cells(spark):
    rows = [("go", "Basic")] * 3 + [("ruby", "Mixed")] + [(None, "Basic")]
    frame = spark.createDataFrame(rows, "l string, c string")
    got = {(r[0], r[1]): r[2] for r in contingency.contingency(frame, "l", "c").collect()}
    assert got == {("go", "Basic"): 3, ("go", "Mixed"): 0, ("ruby", "Basic"): 0,
                   ("ruby", "Mixed"): 1}
    totals = {r["row_key"]: tuple(r)[1:] for r in contingency.row_totals(
        contingency.contingency(frame, "l", "c", ["Basic", "Mixed"])).collect()}
    assert totals == {"go": (False, 3, 1), "ruby": (False, 1, 1), None: (True, 4, 2)}


def test_columns_found_by_name():
    found = contingency.infer_category_columns(
        ["Language", "None %", "no None", "basic cnt", "Mixed ", "Adv."])
    assert found == {"None": "no None", "Basic": "basic cnt", "Mixed": "Mixed ",
                     "Advanced": "Adv."}


def labels(spark):
    totals = {name: sum(r[2 + i] for r in COUNTS)
              for i, name in enumerate(("None", "Basic", "Mixed", "Advanced"))}
    rows = spark.createDataFrame(list(totals.items()), "label string, n int")
    return rows.select(F.explode(F.array_repeat("label", F.col("n"))).alias("exception_type"))


def test_distribution(spark):
    rows = distribution.category_distribution(labels(spark)).collect()
    assert [(r["category"], r["n"], r["pct"]) for r in rows] == [
        ("None", 2630, 15.58), ("Basic", 5503, 32.61), ("Mixed", 8153, 48.31),
        ("Advanced", 590, 3.5)]
    assert math.isclose(sum(r["pct"] for r in rows), 100.0)
    totals = distribution.derived_totals(labels(spark)).first()
    assert (totals["with_handling"], totals["advanced_or_mixed"]) == (14246, 8743)
    assert totals["advanced_or_mixed_pct"] == 51.8
    check = distribution.distribution_check(labels(spark), fail=True).first()
    assert check["counts_ok"] and check["shares_ok"] and check["checked"]


def test_residual_goes_to_mixed_and_empty_domain(spark):
    three = spark.createDataFrame([("None",), ("Basic",), (None,), ("Advanced",), ("Mixed",),
                                   ("Basic",)], "exception_type string")
    rows = {r["category"]: r["pct"] for r in
            distribution.category_distribution(three).collect()}
    assert rows == {"None": 33.33, "Basic": 33.33, "Mixed": 16.67, "Advanced": 16.67}
    empty = distribution.category_distribution(three.limit(0)).collect()
    assert [(r["n"], r["pct"]) for r in empty] == [(0, 0.0)] * 4


def test_unknown_label_is_noticed(spark):
    odd = spark.createDataFrame([("Basic",), ("Odd",)], "exception_type string")
    check = distribution.distribution_check(odd).first()
    assert (check["n_rows"], check["n_counted"], check["counts_ok"]) == (2, 1, False)
    with pytest.raises(Exception, match="distribution mismatch"):
        distribution.distribution_check(odd, fail=True).collect()


def test_adoption(counts):
    table, totals = counts
    rows = adoption.adoption_by_language(table, totals).collect()
    assert all(r["matched"] for r in rows)
    share = {(r["language"], r["pattern"]): r["pct"] for r in rows}
    assert (share["Kotlin", "timeout"], share["Swift", "retry"]) == (89.0, 42.1)
    assert share["Multiple", "status_check"] == 67.4


def test_single_against_multi(counts):
    from faultlens.operators.relational import lookup

    table, totals = counts
    full = lookup(table, totals, "language", scalars.language_join_key)
    compared = adoption.adoption_single_vs_multi(full).collect()
    assert {r["single_repos"] for r in compared} == {10056}
    assert [round(r["single_pct"], 1) for r in compared] == [59.9, 46.2, 8.6, 3.8, 0.5, 37.8]
    assert [round(r["multi_pct"], 1) for r in compared] == [79.3, 60.2, 35.9, 16.2, 4.8, 67.4]
    assert [round(r["ratio"], 2) for r in compared] == [1.33, 1.30, 4.19, 4.29, 9.95, 1.78]
    mean = adoption.adoption_mean(adoption.adoption_single_vs_multi(full)).first()
    assert round(mean["single_mean_pct"], 1) == 26.1 and round(mean["multi_mean_pct"], 1) == 44.0
    assert round(mean["diff_points"], 1) == 17.8 and round(mean["lift_pct"], 1) == 68.3
    subtotal = [r for r in adoption.with_subtotal(full).collect() if r["is_subtotal"]]
    assert len(subtotal) == 1 and subtotal[0]["total_repos"] == 10056
    assert [subtotal[0][p] for p in adoption.PATTERNS] == [6020, 4646, 861, 379, 48, 3804]


def test_patterns_per_repo_rank(counts):
    from faultlens.operators.relational import lookup

    table, totals = counts
    full = lookup(table, totals, "language", scalars.language_join_key)
    rows = adoption.patterns_per_repo(full.where("language <> 'Multiple'")).collect()
    ranked = {r["rank"]: (r["language"], r["total_patterns"]) for r in rows}
    assert ranked[1] == ("Ruby", 418) and ranked[9] == ("Go", 97) and ranked[4][1] == 11033
    best = next(r for r in rows if r["rank"] == 1)
    assert best["patterns_per_repo"] == pytest.approx(2.548780488)


def test_infinite_ratio(spark):
    rows = spark.createDataFrame([("go", 2, 0), ("Multiple", 2, 1)],
                                 "language string, total_repos int, retry int")
    assert adoption.adoption_single_vs_multi(rows, ("retry",)).first()["ratio"] == float("inf")


def test_report_lines(cells, spark, tmp_path):
    test = contingency.with_decision(contingency.chi_square(cells))
    lines = [r["value"] for r in reports.test_lines(test).orderBy("ord").collect()]
    assert lines[0] == "Chi-square: 2400.63" and lines[1] == "Degrees of freedom: 24"
    assert lines[3] == "Cramer's V: 0.2821 (small to medium)"
    out = str(tmp_path / "report")
    reports.write_lines(reports.distribution_lines(
        distribution.category_distribution(labels(spark))), out)
    text = [r["value"] for r in spark.read.text(out).collect()]
    assert text[1].split() == ["Basic", "5,503", "32.61%"]


def test_half_even_rounding(spark):
    one = spark.createDataFrame([(309, 800)], "n int, t int")
    half_up = scalars.share(F.col("n"), F.col("t"))
    half_even = scalars.share(F.col("n"), F.col("t"), rounding="half_even")
    assert one.select(half_up, half_even).first()[:] == (38.63, 38.62)
