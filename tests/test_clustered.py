"""The clustered store: newest row of each key, with the base left where it lies."""

import re

from pyspark.sql import functions as F

from faultlens.sources import clustered

SCHEMA = "k string, v long, names array<string>, at int"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, [str(v)], at) for k, v, at in rows], SCHEMA)


def found(spark, folder):
    return {r.k: r.v for r in clustered.load_clustered(spark, folder).collect()}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def above_base(plan, base):
    """Names of the operators between the base's scan and the join."""
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and base in line)
    depth = lambda line: len(re.match(r"[\s:+\-|]*", line).group())
    out, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            level = depth(line)
            out.append(line.strip(" :+-"))
            if "Join" in line:
                break
    return out


def test_newest_row_of_each_key(spark, tmp_path):
    folder = str(tmp_path / "store")
    clustered.create_store(frame(spark, [("a", 1, 0), ("b", 1, 0), ("b", 2, 1), (None, 1, 0)]), folder, "k", 4, "at")
    assert found(spark, folder) == {"a": 1, "b": 2}
    clustered.append_batch(frame(spark, [("a", 5, 0), ("c", 5, 1), ("c", 6, 2), (None, 5, 0)]), folder, 1, "at")
    expected = {"a": 5, "b": 2, "c": 6}
    assert found(spark, folder) == expected
    clustered.append_batch(frame(spark, []), folder, 2)
    clustered.append_batch(frame(spark, [("b", 9, 0)]), folder, 4)
    clustered.append_batch(frame(spark, [("b", 8, 0), ("a", 8, 0)]), folder, 3)
    expected.update(a=8, b=9)
    assert found(spark, folder) == expected
    # A batch that is written again replaces itself.
    clustered.append_batch(frame(spark, [("b", 7, 0)]), folder, 4)
    expected.update(b=7)
    assert found(spark, folder) == expected
    clustered.merge_batches(spark, folder)
    assert found(spark, folder) == expected
    clustered.append_batch(frame(spark, [("d", 1, 0)]), folder, 5)
    assert found(spark, folder) == {**expected, "d": 1}


def test_columns_that_differ(spark, tmp_path):
    folder = str(tmp_path / "store")
    clustered.create_store(frame(spark, [("a", 1, 0)]), folder, "k", 2)
    clustered.append_batch(spark.createDataFrame([("a", 3, "x")], "k string, v int, other string"), folder, 0)
    row = clustered.load_clustered(spark, folder).first()
    assert row.asDict() == {"k": "a", "v": 3, "names": None, "at": None}


def test_the_store_is_not_shuffled(spark, tmp_path):
    folder = str(tmp_path / "store")
    many = spark.range(20_000).select(
        F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v"), F.array(F.lit("x")).alias("names"),
        F.lit(0).alias("at"))
    clustered.create_store(many, folder, "k", 6)
    clustered.append_batch(frame(spark, [("k1", -1, 0), ("new", -2, 0)]), folder, 1)
    loaded = clustered.load_clustered(spark, folder)
    plan = plan_of(loaded)
    between = above_base(plan, "spark_catalog.default.clustered_")
    assert any("SortMergeJoin" in x for x in between) and not any("Exchange" in x for x in between), between
    assert loaded.count() == 20_001
    assert plan.count("Exchange") == 1  # the batch's
    clustered.merge_batches(spark, folder)
    merged = clustered.load_clustered(spark, folder)
    assert "Exchange" not in plan_of(merged)
    names = [f.rsplit("/", 1)[-1] for f in merged.inputFiles()]
    assert len(names) == 6  # one file a bucket
    # A join on the key needs no shuffle of the store either.
    others = clustered.aligned(frame(spark, [("k2", 0, 0)]).select("k"), folder)
    joined = merged.join(others, "k", "left_anti")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert not any("Exchange" in x for x in above_base(plan_of(joined), "spark_catalog.default.clustered_"))
        assert joined.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_lost_write_is_not_read(spark, tmp_path):
    folder = str(tmp_path / "store")
    clustered.create_store(frame(spark, [("a", 1, 0)]), folder, "k", 2)
    frame(spark, [("a", 9, 0)]).write.parquet(f"{folder}/batch-0-1")  # written, never entered
    assert found(spark, folder) == {"a": 1}
