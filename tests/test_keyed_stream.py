"""Newest versions of files as state, against a batch scan of what stands."""

import random

import pytest
from pyspark.sql import functions as F

from faultlens.plans.scan import scan_corpus
from faultlens.streaming import keyed

SCHEMA = "repo_url string, path string, language string, content string, decode_ok boolean, version long"
BODIES = ["x = 1\n", "try:\n  f()\nexcept E: pass\n", "timeout(1)\n", "import requests\nretry(2)\n", "f(\n",
          "try:\n  timeout(1)\nexcept E: pass\n"]


def rows_of(frame):
    return sorted((r.repo_url, r.total_files, r.failed_files, r.handled_files, r.exception_type, r.languages,
                   r.http_libraries, r.parser_success_rate) for r in frame.collect())


def standing(deliveries):
    newest = {}
    for row in (r for batch in deliveries for r in batch):
        if row[0] is not None and (row[0], row[1]) not in newest or row[5] > newest[row[0], row[1]][5]:
            newest[row[0], row[1]] = row
    return list(newest.values())


def run(spark, tmp_path, deliveries, parts):
    session = keyed.stateful_session(spark)
    drops, store, state = (str(tmp_path / n) for n in ("drops", "store", "state"))
    for batch in deliveries:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(drops)
        stream = session.readStream.schema(SCHEMA).parquet(drops)
        keyed.start_keyed_scan(stream, store, F.col("version"), state, parts,
                               languages=("python",)).awaitTermination()
    return store


def test_redelivered_late_and_repeated_files(spark, tmp_path):
    def row(path, body, version, repo="r"):
        return (repo, path, "python", BODIES[body], True, version)

    deliveries = [
        [row("a.py", 1, 5), row("b.py", 2, 5), row("b.py", 2, 5), row("z.py", 0, 1, "s")],
        # a.py anew without handling, b.py late, c.py twice in one batch
        [row("a.py", 0, 7), row("b.py", 0, 3), row("c.py", 3, 1), row("c.py", 4, 2)],
        [row("b.py", 2, 5), row("a.py", 1, 6), row("d.py", 5, 1)],
    ]
    store = run(spark, tmp_path, deliveries, 2)
    expected = scan_corpus(spark.createDataFrame(standing(deliveries), SCHEMA), languages=("python",))
    got = keyed.keyed_results(spark, store)
    assert rows_of(got) == rows_of(expected)
    assert {r.repo_url: r.flags for r in got.collect()} == {"r": {"timeout": 2, "try_catch": 1}, "s": {}}
    # Only repositories that changed are written.
    written = spark.read.parquet(store).groupBy("batch_id").agg(F.collect_set("repo_url").alias("r")).collect()
    assert {r.batch_id: sorted(r.r) for r in written} == {0: ["r", "s"], 1: ["r"], 2: ["r"]}


@pytest.mark.parametrize("parts", [1, 8])
def test_any_order_of_deliveries(spark, tmp_path, parts):
    choose = random.Random(parts)
    deliveries, version = [], 0
    for _ in range(3):
        batch = []
        for _ in range(60):
            version += 1
            batch.append((choose.choice(["hot", "hot", "x", "y"]), f"p{choose.randrange(12)}.py", "python",
                          choose.choice(BODIES), True, choose.choice([version, version - 40])))
        deliveries.append(batch)
    # One version a file and number, so that the order of rows cannot matter.
    seen = set()
    deliveries = [[r for r in b if (r[0], r[1], r[5]) not in seen and not seen.add((r[0], r[1], r[5]))]
                  for b in deliveries]
    store = run(spark, tmp_path, deliveries, parts)
    expected = scan_corpus(spark.createDataFrame(standing(deliveries), SCHEMA), languages=("python",))
    assert rows_of(keyed.keyed_results(spark, store)) == rows_of(expected)


def test_odd_rows(spark, tmp_path):
    deliveries = [[(None, "a.py", "python", BODIES[1], True, 1), ("r", None, "python", BODIES[1], True, None),
                   ("r", None, "python", BODIES[1], True, None), ("r", "b.py", None, None, False, None)],
                  [("r", "b.py", "python", BODIES[2], True, 0)]]
    got = keyed.keyed_results(spark, run(spark, tmp_path, deliveries, 4)).collect()
    assert [(r.repo_url, r.total_files, r.failed_files, r.exception_type) for r in got] == [("r", 2, 0, "Mixed")]


def test_other_sessions_are_refused(spark):
    with pytest.raises(ValueError):
        keyed.keyed_rows(spark.readStream.format("rate").load(), F.lit(1))
