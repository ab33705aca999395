"""Nothing is dropped for its name, its place or its length."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from faultlens.operators import contingency, libraries
from faultlens.operators.rollup import Domains, finish_rollup, merge_partials, partial_rollup, repo_results
from faultlens.operators.rollup import with_empty_repositories
from faultlens.operators.signals import _IMPORT_FORMS, _find_all, rules_from_table
from faultlens.sources.files import read_source_tree
from faultlens.streaming import incremental as inc

SIGNALS = """repo_url string, path string, language string, label string, parse_status string,
basic boolean, advanced boolean, flags array<string>, http_libraries array<string>,
resilience_libraries array<string>"""


def signals(spark):
    return spark.createDataFrame([
        ("r", "a", "scala", "Basic", "ok", True, False, ["my_flag", "timeout"], ["axios", "myhttp"], ["mylib"]),
        ("r", "b", "python", "None", "ok", False, False, ["my_flag", "your_flag"], [], ["mylib", "other:lib"]),
        ("q", "c", "go", "None", "ok", False, False, [], [], [])], SIGNALS)


def test_unlisted_names_reach_the_repository(spark):
    rows = {r["repo_url"]: r for r in repo_results(signals(spark)).collect()}
    assert rows["r"]["languages"] == ["python", "scala"]
    assert rows["r"]["http_libraries"] == ["axios", "myhttp"]
    assert rows["r"]["resilience_libraries"] == ["mylib", "other:lib"]
    assert rows["r"]["other_flags"] == ["my_flag", "your_flag"] and rows["r"]["n_timeout"] == 1
    assert rows["q"]["other_flags"] == [] and rows["q"]["languages"] == ["go"]


def test_merged_partials_keep_unlisted_names(spark):
    partials = [partial_rollup(signals(spark).where(F.col("path") == p)) for p in "abc"]
    merged = finish_rollup(merge_partials(partials[0].union(partials[1]).union(partials[2])))
    assert sorted(map(tuple, merged.collect()), key=str) == sorted(
        map(tuple, repo_results(signals(spark)).collect()), key=str)


def test_states_of_other_lists_are_refused(spark, tmp_path):
    store = str(tmp_path / "store")
    partial_rollup(signals(spark)).write.parquet(f"{store}/batch_id=0")
    changed = Domains(http_libraries=("a_new_name", *Domains().http_libraries))
    assert inc.current_results(spark, store).count() == 2
    with pytest.raises(Exception, match="other lists of names"):
        inc.current_results(spark, store, changed).collect()


def test_a_file_that_comes_twice_counts_once(spark, tmp_path):
    store = str(tmp_path / "store")
    for batch in (0, 1):
        partial_rollup(signals(spark)).write.parquet(f"{store}/batch_id={batch}")
    totals = {r["repo_url"]: r["total_files"] for r in inc.current_results(spark, store).collect()}
    assert totals == {"r": 2, "q": 1}


def test_root_that_occurs_inside_a_repository(spark, tmp_path):
    root = tmp_path / "src"
    inner = root / "owner__name" / str(root).lstrip("/") / "x"
    inner.mkdir(parents=True)
    (inner / "a.py").write_text("x = 1\n")
    for named in (str(root), f"file://{root}", f"file:{root}/"):
        (row,) = read_source_tree(spark, named).select("repo_url", "path").collect()
        assert row["repo_url"] == "owner__name" and row["path"].endswith("src/x/a.py")


def test_list_and_results_meet_by_key_and_both_stay(spark):
    results = repo_results(signals(spark)).withColumn("repo_url", F.when(
        F.col("repo_url") == "r", "owner__r").otherwise("unlisted__q"))
    listed = spark.createDataFrame(
        [("https://example.com/owner/r.git",), ("https://example.com/owner/r",),
         ("https://example.com/owner/none",)], "repo_url string")
    rows = {r["repo_url"]: r for r in with_empty_repositories(results, listed).collect()}
    assert set(rows) == {"owner__r", "unlisted__q", "https://example.com/owner/none"}
    assert rows["owner__r"]["total_files"] == 2 and rows["owner__r"]["status"] == "ok"
    assert rows["https://example.com/owner/none"]["status"] == "no_files"


PLAIN = r"""import\s+.*?\s+from\s+['"]([^'"]+)['"]"""


def test_import_search_finds_what_the_plain_pattern_finds(spark):
    rng = random.Random(4)
    parts = ["import", " ", "  ", "\n", "from", "'x'", '"y"', "a", "{b}", "important", "i", "'", "import a from 'z'"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(3000)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = table.select("i", F.expr(_find_all("t", _IMPORT_FORMS["javascript"][0])).alias("n")).collect()
    for row in found:
        assert [n for n in row["n"] if n] == re.findall(PLAIN, texts[row["i"]]), repr(texts[row["i"]])


def test_import_search_is_linear(spark):
    def seconds(text, times):
        table = spark.createDataFrame([(text * times,)], "t string")
        start = time.perf_counter()
        table.select(*(F.expr(_find_all("t", form)) for form in _IMPORT_FORMS["javascript"])).collect()
        return time.perf_counter() - start

    for text in ("use import a; ", "import ", "import" + " " * 400, "import 'a from ", "require ( "):
        seconds(text, 10)
        n = 2_500_000 // len(text)
        small, large = seconds(text, n), seconds(text, 2 * n)  # the larger: 5 MB on one line
        assert large < max(3 * small, 10), text


def test_patterns_of_one_letter(spark):
    paths = spark.createDataFrame([("abcde",), ("xbz",), ("b",), ("",)], "path string")
    patterns = ["b", "bc", "abcd", "abcdef", "cde", "z", ""]
    catalog = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    found = {(r["path"], r["pattern"]) for r in libraries.match_contains(paths, catalog).collect()}
    assert found == {(p, q) for p in ("abcde", "xbz", "b", "") for q in patterns if q and q in p}


def test_grid_of_many_columns(spark):
    pairs = spark.range(1500).selectExpr("id % 3 AS r", "id AS c")
    cells = contingency.contingency(pairs, "r", "c")
    assert cells.count() == 4500 and cells.agg(F.sum("n")).first()[0] == 1500


def test_every_field_of_a_rule_fits_in_a_table(spark):
    table = spark.createDataFrame(
        [("k.retry", "kotlin", "raw", "retry", "advanced", ["retry"], None, ["retry"], None),
         ("k.backoff", "kotlin", "raw", "delay", None, None, "k.retry", None, "fixed")],
        """rule_id string, language string, target string, pattern string, tier string,
        flags array<string>, requires string, stems array<string>, only string""")
    retry, backoff = rules_from_table(table)
    assert retry.stems == ("retry",) and retry.flags == ("retry",) and retry.enabled
    assert backoff.requires == "k.retry" and backoff.only == "fixed" and backoff.tier is None
