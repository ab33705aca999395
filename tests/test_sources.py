"""Reading and writing: repository lists, source trees, tables, analyzer output."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from faultlens.catalogs import domain
from faultlens.functions import scalars
from faultlens.operators import relational
from faultlens.plans.scan import scan_and_store, study
from faultlens.sources import analyzer_output, files, repositories, tables


def test_repository_list(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_bytes((
        "﻿id,hostname,repo_url,watcher,forks,stars,commits,last_updated,forked_by,readme,"
        "language,category\n"
        "0,h,https://x.example/o/a,1,0,7,,,,,Go,Web\n"
        "0,h,https://x.example/o/a/,1,0,n/a,,,,,Go,\"Web, more\"\n"
        "0,h,https://x.example/o/u.git.io.git,2,1,300,,,,,None,Web\n").encode())
    read = repositories.read_repositories(spark, str(path))
    rows = read.collect()
    assert [r["id"] for r in rows] == ["0", "0", "0"]
    assert [r["stars"] for r in rows] == [7, None, 300]
    assert rows[2]["language"] == "None" and rows[1]["category"] == "Web, more"
    keys = repositories.distinct_repositories(read).orderBy("repo_key").collect()
    assert [r["repo_key"] for r in keys] == ["o__a", "o__u.git.io"]
    parity = read.select(scalars.repo_key(F.col("repo_url"), "parity")).collect()
    assert parity[2][0] == "o__u.io"


def test_star_buckets(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 2, 10, 11, 50, 51, 200, 201)], "n int")
    got = [r[0] for r in rows.select(scalars.star_bucket(F.col("n"))).collect()]
    assert got == ["0", "1", "2-10", "2-10", "11-50", "11-50", "51-200", "51-200", ">200"]


def test_single_segment_url(spark):
    row = spark.createDataFrame([("solo",)], "u string").select(scalars.repo_key(F.col("u")))
    assert row.first()[0] == "unknown__solo"


def write(root, path, content):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as handle:
        handle.write(content)


def test_source_tree(spark, tmp_path):
    root = str(tmp_path / "clones")
    write(root, "o__a/main.py", b"import requests\r\n")
    write(root, "o__a/src/x.go", "import \"net/http\" // é".encode())
    write(root, "o__a/src/latin.rb", "café".encode("latin-1"))
    write(root, "o__a/node_modules/y.js", b"fetch()")
    write(root, "o__a/a/.git/z.py", b"x")
    write(root, "o__a/outer/k.kt", b"fun f() = 1")
    write(root, "o__b/types.d.ts", b"\xef\xbb\xbfexport {}")
    write(root, "o__b/view.tsx", b"x")
    write(root, "o__b/UP.PY", b"x")
    write(root, "o__b/dist.swift", b"let x = 1")
    read = files.read_source_tree(spark, root)
    got = {(r["repo_url"], r["path"]): r for r in read.collect()}
    assert set(got) == {
        ("o__a", "main.py"), ("o__a", "src/x.go"), ("o__a", "src/latin.rb"),
        ("o__a", "outer/k.kt"), ("o__b", "types.d.ts"), ("o__b", "dist.swift")}
    assert got["o__a", "main.py"]["content"] == "import requests\n"
    assert got["o__b", "types.d.ts"]["language"] == "typescript"
    latin = got["o__a", "src/latin.rb"]
    assert (latin["decode_ok"], latin["content"], latin["size_bytes"]) == (False, None, 4)

    packed = str(tmp_path / "packed")
    files.pack_files(read, packed, 3)
    again = files.read_packed(spark, packed)
    assert again.count() == 6
    plan = again.where("language = 'go'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(language" in plan

    store = str(tmp_path / "store")
    rows = {r["repo_url"]: r for r in scan_and_store(again, store).collect()}
    assert rows["o__a"]["http_libraries"] == ["net/http", "requests"]
    assert rows["o__a"]["failed_files"] == 1 and rows["o__b"]["status"] == "ok"
    report = study(tables.load_results(spark, store))
    assert report["library_coverage"].first()["with_library"] == 1
    assert {name for name, table in report.items() if table.count() >= 0} == set(report)

    out = str(tmp_path / "csv")
    tables.export_csv(tables.load_results(spark, store), out)
    read = spark.read.option("header", True).csv(out)
    assert read.columns[:2] == ["repo_url", "Exception Type"] and len(read.columns) == 12
    assert {r["HTTP Libraries"] for r in read.collect()} == {"net/http; requests", "None detected"}


def test_results_store_is_replaced_per_batch_and_latest_wins(spark, tmp_path):
    store = str(tmp_path / "store")
    row = lambda url, label: (url, label, 1.0)
    schema = "repo_url string, exception_type string, parser_success_rate double"
    make = lambda *rows: spark.createDataFrame(list(rows), schema)
    tables.append_results(make(row("a", "None"), row("b", "Basic")), store, 1)
    tables.append_results(make(row("a", "Mixed")), store, 2)
    tables.append_results(make(row("a", "Advanced")), store, 2)
    got = {r["repo_url"]: r["exception_type"] for r in tables.load_results(spark, store).collect()}
    assert got == {"a": "Advanced", "b": "Basic"}


def test_load_table(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("﻿Language,None ,Mixed \nGo,1,2\nNone,,3\n")
    table = tables.load_table(spark, str(path))
    assert table.columns == ["Language", "None", "Mixed"]
    assert [tuple(r) for r in table.collect()] == [("Go", "1", "2"), ("None", None, "3")]
    for bad in ("x.xlsx", "x.xls", "x.json"):
        with pytest.raises(ValueError):
            tables.load_table(spark, bad)


CASES = [
    ('{"hasBasicHandling": true, "hasAdvancedHandling": false, "patterns": {"try_catch": true, '
     '"retry": false}, "resilienceLibraries": ["p-retry"]}', "json", "Basic", ["try_catch"],
     ["p-retry"]),
    ('{"hasAdvancedHandling": true, "resilience_libraries": ["Polly", "Polly"]}', "json",
     "Advanced", [], ["Polly"]),
    ("{}", "json", "None", [], []),
    ('{"parse_error": "bad token", "patterns": {}}', "json", "None", [], []),
    (" true,False ", "legacy", "Basic", [], []),
    ("true, true", "legacy", "Mixed", [], []),
    ("boom", "failed", "None", [], []),
    ("{broken", "failed", "None", [], []),
    ("a,b", "failed", "None", [], []),
    ("", "failed", "None", [], []),
    (None, "failed", "None", [], []),
]


def test_analyzer_output(spark):
    raw = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id int, raw string")
    rows = analyzer_output.ingest(raw).orderBy("id").collect()
    for case, row in zip(CASES, rows):
        assert (row["status"], row["label"], row["flags"], row["resilience_libraries"]) == case[1:]
        assert row["parse_status"] == ("failed" if case[1] == "failed" else "ok")
    assert rows[3]["parse_error"] == "bad token"
    parity = analyzer_output.ingest(raw, mode="parity").orderBy("id").collect()
    assert parity[8]["status"] == "legacy" and parity[4]["parse_status"] == "failed"


def test_relational_operators(spark):
    data = spark.createDataFrame([(" Go ", 1), ("Rust", 2)], "language string, n int")
    table = spark.createDataFrame([("go", 9)], "language string, total int")
    got = {r["language"]: (r["total"], r["matched"]) for r in
           relational.lookup(data, table, "language", scalars.language_join_key).collect()}
    assert got == {" Go ": (9, True), "Rust": (None, False)}
    assert [r[0] for r in relational.unmatched_keys(
        data, table, "language", scalars.language_join_key).collect()] == ["Rust"]

    keys = spark.createDataFrame([("b", 1), ("a", 2)], "k string, ord int")
    rows = spark.createDataFrame([("a", 10), ("b", 20), ("c", 30)], "k string, v int")
    assert [r["v"] for r in relational.reorder(rows, keys, "k").collect()] == [20, 10]
    more = keys.union(spark.createDataFrame([("z", 3)], "k string, ord int"))
    assert relational.reorder(rows, more, "k", strict=False).count() == 2
    with pytest.raises(Exception, match="no row for key: z"):
        relational.reorder(rows, more, "k").collect()


@pytest.mark.parametrize("ranges", [1, 5])
def test_numbered_batches(spark, ranges):
    ids = [i * i for i in range(1003)]
    rows = spark.createDataFrame([(i,) for i in ids], "id bigint").repartition(6)
    got = {r["id"]: r["batch_id"] for r in
           relational.numbered_batches(rows, "id", 50, ranges).collect()}
    assert got == {x: k // 50 for k, x in enumerate(ids)}


def test_display_names(spark):
    names = ["csharp", "Java ", "Javascript", "multiple", "Cobol"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in rows.select(scalars.display_language(F.col("n"))).collect()] == [
        "C#", "Java", "JavaScript", "Multiple", "Cobol"]


def test_permanent_errors(spark):
    texts = [e.upper() for e in domain.PERMANENT_FETCH_ERRORS] + ["timed out", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in rows.select(scalars.is_permanent_fetch_error(F.col("t"))).collect()]
    assert got == [True] * 6 + [False] * 3
    assert datetime.date.today()
