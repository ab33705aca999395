"""Own analyzers next to the built-in ones."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from conftest import files_of
from faultlens.operators.analyzers import RESULT, classify_with


@F.pandas_udf(StringType())
def shout(content: pd.Series) -> pd.Series:
    return content.map(lambda c: None if c is None or "?" in c else
                       ("Advanced" if c.isupper() else "None"))


def braces(content):
    return F.when(content != "", F.struct(
        content.contains("{").alias("basic"), F.lit(False).alias("advanced"),
        F.create_map(F.lit("braces"), content.contains("{"), F.lit("no"), F.lit(False))
        .alias("patterns"),
        F.array(F.lit("b"), F.lit("b")).alias("libraries")).cast(RESULT))


def test_own_analyzers(spark):
    files = files_of(spark, [
        ("lua", "ABC"), ("lua", "abc"), ("lua", "a?"), ("go", "func f() { retryIt() }"),
        ("kotlin", "fun f() { retry { } }"), ("kotlin", "")])
    out = classify_with(files, {"lua": shout, "kotlin": braces}).orderBy("id").collect()
    assert [(r["label"], r["parse_status"], r["flags"], r["resilience_libraries"])
            for r in out] == [
        ("Advanced", "ok", [], []), ("None", "ok", [], []), ("None", "failed", [], []),
        ("Advanced", "ok", ["retry"], []), ("Basic", "ok", ["braces"], ["b"]),
        ("None", "failed", [], [])]
    assert "_own" not in out[0].asDict()
