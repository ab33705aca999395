"""Incremental scans equal batch scans, however the files arrive."""

import pytest

from faultlens.operators.relational import latest_wins
from faultlens.plans.scan import scan_corpus
from faultlens.session import checkpoint_dir
from faultlens.streaming import incremental as inc

BODIES = ["x = 1\n", "try:\n  f()\nexcept E: pass\n", "timeout(1)\n", "import requests\nretry(2)\n"]


def files(spark, numbers):
    rows = [(f"repo{n % 4}", f"p{n:03d}.py", ".py", "python", BODIES[(n * 5) % 4], True, 10)
            for n in numbers]
    return spark.createDataFrame(rows, inc.FILES_SCHEMA)


def plain(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_incremental_scan(spark, tmp_path):
    drops, store, state = (str(tmp_path / n) for n in ("drops", "store", "state"))
    everything = files(spark, range(40))
    files(spark, range(0, 25)).repartition(3).write.parquet(drops)

    def run():
        query = inc.start_scan(inc.new_files(spark, drops, 1), store, state,
                               languages=("python",))
        query.awaitTermination()

    run()
    assert plain(inc.current_results(spark, store, merge=True)) == plain(
        scan_corpus(files(spark, range(25)), languages=("python",)))
    files(spark, range(25, 40)).coalesce(2).write.mode("append").parquet(drops)
    run()
    run()  # nothing new
    batch = scan_corpus(everything, languages=("python",))
    assert plain(inc.current_results(spark, store, merge=True)) == plain(batch)
    assert inc.progress(spark, store).count() == 5

    compacted = str(tmp_path / "compacted")
    inc.compact(spark, store, compacted)
    assert plain(inc.current_results(spark, compacted, merge=True)) == plain(batch)

    listed = spark.createDataFrame([("repo0",), ("repo9",)], "repo_url string")
    left = inc.remaining(listed, inc.current_results(spark, store)).collect()
    assert [r["repo_url"] for r in left] == ["repo9"]


def test_newest_batch_wins_when_repositories_are_scanned_anew(spark, tmp_path):
    from faultlens.operators.rollup import partial_rollup
    from faultlens.operators.signals import classify_files

    store = str(tmp_path / "store")
    for batch, numbers in ((0, (0, 1, 2)), (1, (2,))):
        partial_rollup(classify_files(files(spark, numbers), languages=("python",))).write.parquet(
            f"{store}/batch_id={batch}")
    newest = {r["repo_url"]: r["total_files"] for r in
              inc.current_results(spark, store).collect()}
    assert newest == {"repo0": 1, "repo1": 1, "repo2": 1}
    merged = {r["repo_url"]: r["total_files"] for r in
              inc.current_results(spark, store, merge=True).collect()}
    assert merged["repo2"] == 2


def test_only_a_redelivered_file_is_replaced(spark, tmp_path):
    drops, store, state, small = (str(tmp_path / n) for n in ("drops", "store", "state", "small"))

    def deliver(frame):
        frame.coalesce(1).write.mode("append").parquet(drops)
        inc.start_scan(inc.new_files(spark, drops, 1), store, state, languages=("python",)).awaitTermination()

    def row(path, body):
        return ("repo0", path, ".py", "python", body, True, 10)

    def frame(*rows):
        return spark.createDataFrame(rows, inc.FILES_SCHEMA)

    first = [row("a.py", BODIES[1]), row("b.py", BODIES[0]), row(None, BODIES[0])]
    second = [row("c.py", BODIES[2]), row("b.py", BODIES[3]), row("b.py", BODIES[3]), row(None, BODIES[1])]
    deliver(frame(*first))
    deliver(frame(*second))
    stand = frame(first[0], first[2], second[0], second[1], second[3])
    expected = plain(scan_corpus(stand, languages=("python",)))
    assert plain(inc.current_results(spark, store)) == expected
    assert {(r["batch_id"], r["n_rows"]) for r in inc.progress(spark, store).collect()} == {(0, 1), (1, 1)}
    inc.compact(spark, store, small)
    assert plain(inc.current_results(spark, small)) == expected


def test_compaction_follows_the_rule_of_reading(spark, tmp_path):
    from faultlens.operators.rollup import partial_rollup
    from faultlens.operators.signals import classify_files

    store = str(tmp_path / "store")
    for batch, numbers in ((0, (0, 4, 1)), (1, (4,))):
        partial_rollup(classify_files(files(spark, numbers), languages=("python",))).write.parquet(
            f"{store}/batch_id={batch}")
    for merge in (False, True):
        target = str(tmp_path / f"compacted-{merge}")
        inc.compact(spark, store, target, merge)
        assert plain(inc.current_results(spark, target)) == plain(inc.current_results(spark, store, merge=merge))


def test_latest_wins_on_a_hot_key(spark):
    rows = spark.range(3000).selectExpr("IF(id % 3 = 0, 'hot', concat('k', id)) AS k", "id AS v")
    got = {r["k"]: r["v"] for r in latest_wins(rows, "k", "v").collect()}
    assert got["hot"] == 2997 and len(got) == 2001


class Session:
    """Just the setting."""

    def __init__(self, value):
        self.conf = {"spark.checkpoint.dir": value} if value else {}


def test_checkpoint_folder_comes_from_the_session():
    assert checkpoint_dir(Session("/shared"), "x") == "/shared"
    assert checkpoint_dir(Session(None), "x") == "x"
    with pytest.raises(ValueError):
        checkpoint_dir(Session(None))
