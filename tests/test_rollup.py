"""Folding files into repositories."""

import itertools

import pytest
from pyspark.sql import functions as F

from faultlens.catalogs import domain
from faultlens.operators import rollup as R
from faultlens.plans.scan import scan_corpus

LABELS = ("None", "Basic", "Advanced", "Mixed")


def walk(labels):
    """The state machine the closed form stands for."""
    state = "None"
    for label in labels:
        if label == "None":
            continue
        if state == "None":
            state = label
        elif {state, label} == {"Basic", "Advanced"}:
            state = "Mixed"
    return state


def test_fold_equals_the_state_machine(spark):
    sequences = [s for n in range(1, 6) for s in itertools.product(LABELS, repeat=n)]
    rows = [(i, k, label) for i, s in enumerate(sequences) for k, label in enumerate(s)]
    frame = spark.createDataFrame(rows, "repo int, ord int, label string").repartition(7)
    got = {r["repo"]: r["exception_type"] for r in R.fold_labels(frame, ["repo"], "ord").collect()}
    assert all(got[i] == walk(s) for i, s in enumerate(sequences))
    assert len(got) == len(sequences)


def test_any_fold(spark):
    rows = [(1, "Basic"), (1, "Mixed"), (2, "None"), (3, "Advanced"), (3, "None")]
    got = dict(R.fold_labels_any(
        spark.createDataFrame(rows, "repo int, label string"), ["repo"]).collect())
    assert got == {1: "Mixed", 2: "None", 3: "Advanced"}


def signals(spark):
    rows = []
    for i in range(400):
        label = LABELS[(i * 7) % 4]
        rows.append((
            f"r{i % 3 if i % 2 else 9}", f"p{(i * 37) % 400:03d}",
            domain.LANGUAGES[i % 9], "failed" if i % 11 == 0 else "ok",
            label in ("Basic", "Mixed"), label in ("Advanced", "Mixed"), label,
            [["retry"], ["rescue", "timeout"], []][i % 3],
            [["axios"], [], ["fetch", "requests"]][i % 3], [["Polly"], []][i % 2]))
    return spark.createDataFrame(
        rows, "repo_url string, path string, language string, parse_status string, "
              "basic boolean, advanced boolean, label string, flags array<string>, "
              "http_libraries array<string>, resilience_libraries array<string>")


def plain(results):
    return sorted(tuple(r) for r in results.collect())


def test_against_plain_python(spark):
    frame = signals(spark)
    want = {}
    for r in sorted(frame.collect(), key=lambda r: r["path"]):
        repo = want.setdefault(r["repo_url"], {
            "labels": [], "n": 0, "bad": 0, "langs": set(), "http": set(), "res": set(),
            "retry": 0, "try": 0})
        repo["n"] += 1
        repo["bad"] += r["parse_status"] == "failed"
        repo["labels"].append("None" if r["parse_status"] == "failed" else r["label"])
        repo["langs"].add(r["language"])
        repo["http"].update(r["http_libraries"])
        repo["res"].update(r["resilience_libraries"])
        analysed = r["parse_status"] != "failed"
        repo["retry"] += analysed and "retry" in r["flags"]
        repo["try"] += analysed and "rescue" in r["flags"]
    got = {r["repo_url"]: r for r in R.repo_results(frame).collect()}
    assert set(got) == set(want)
    for name, repo in want.items():
        row = got[name]
        assert row["exception_type"] == walk(repo["labels"])
        assert (row["total_files"], row["failed_files"]) == (repo["n"], repo["bad"])
        assert row["handled_files"] == sum(x != "None" for x in repo["labels"])
        assert row["languages"] == sorted(repo["langs"])
        assert row["http_libraries"] == sorted(repo["http"])
        assert row["resilience_libraries"] == sorted(repo["res"])
        assert (row["n_retry"], row["n_try_catch"]) == (repo["retry"], repo["try"])
        assert row["parser_success_rate"] == pytest.approx((repo["n"] - repo["bad"]) / repo["n"])
        assert row["recommendation"] == domain.RECOMMENDATION[row["exception_type"]]


def test_partition_layout_does_not_matter(spark):
    frame = signals(spark)
    base = plain(R.repo_results(frame))
    assert plain(R.repo_results(frame.repartition(13))) == base
    assert plain(R.repo_results(frame.coalesce(1).orderBy(F.rand(3)))) == base


def test_merged_partials_equal_one_pass(spark):
    frame = signals(spark)
    parts = [R.partial_rollup(frame.where(F.crc32("path") % 3 == k)) for k in range(3)]
    merged = R.merge_partials(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert plain(R.finish_rollup(merged)) == plain(R.repo_results(frame))


def test_parity_has_no_canonical_flag(spark):
    frame = signals(spark)
    assert sum(r["n_try_catch"] for r in R.repo_results(frame, canonical=False).collect()) == 0
    assert sum(r["n_rescue"] for r in R.repo_results(frame).collect()) > 0


def test_empty_repositories_and_rendering(spark):
    files = spark.createDataFrame(
        [("u1", "a.py", "python", "import requests\ntry:\n  f()\nexcept E: pass\n", True),
         ("u2", "b.go", "go", None, False)],
        "repo_url string, path string, language string, content string, decode_ok boolean")
    listed = spark.createDataFrame([("u1",), ("u2",), ("u3",), ("u3",)], "repo_url string")
    results = scan_corpus(files, listed)
    got = {r["repo_url"]: r for r in results.collect()}
    assert {k: v["status"] for k, v in got.items()} == {
        "u1": "ok", "u2": "all_failed", "u3": "no_files"}
    assert (got["u3"]["parser_success_rate"], got["u3"]["languages"]) == (0.0, [])
    assert got["u2"]["languages"] == []
    text = {r["repo_url"]: r.asDict() for r in R.rendered(results).collect()}
    assert text["u1"] == {
        "repo_url": "u1", "Exception Type": "Basic",
        "Recommendation": domain.RECOMMENDATION["Basic"], "Languages": "python",
        "HTTP Libraries": "requests", "Parser Success Rate": "100.00%", "Has Try-Catch": True,
        "Has Timeout": False, "Has Retry": False, "Has Circuit Breaker": False,
        "Has Backoff": False, "Has Status Check": False}
    assert text["u3"]["HTTP Libraries"] == "None detected"
    assert text["u2"]["Parser Success Rate"] == "0.00%"


def test_a_hot_repository_with_a_name_for_every_file(spark):
    """Names are combined as rows, so no state holds combinations of them."""
    files = spark.range(600_000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 500)).alias("repo_url"),
        F.format_string("%07d", "id").alias("path"), F.lit("ok").alias("parse_status"),
        F.lit("python").alias("language"), F.lit("Basic").alias("label"), F.lit(True).alias("basic"),
        F.lit(False).alias("advanced"),
        F.array(F.concat(F.lit("a"), F.col("id") % 50_000), F.concat(F.lit("b"), F.floor(F.col("id") / 50_000)))
        .alias("flags"))
    partial = R.partial_rollup(files)
    found = {r["repo_url"]: r for r in partial.select("repo_url", "total_files", "unlisted").collect()}
    assert found["hot"]["total_files"] == 400_000 and len(found) == 501
    # 50,000 names of one kind and 12 of the other, in 400,000 combinations.
    assert len(found["hot"]["unlisted"]) == 50_012
    twice = R.merge_partials(partial.unionByName(partial)).where("repo_url = 'hot'").first()
    assert twice["total_files"] == 800_000 and len(twice["unlisted"]) == 50_012
