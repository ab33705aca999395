"""Masking and normalisation."""

from pyspark.sql import functions as F

from faultlens.functions import text


def apply(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in rows.select("i", column).orderBy("i").collect()]


def squeeze(values):
    return [" ".join(v.split()) for v in values]


def test_masks(spark):
    mask = lambda lang, *v: squeeze(apply(spark, text.mask_code(F.col("t"), lang), *v))
    assert mask("java", 'a("x // y"); // b', "a /* x \n \" */ b", "c('\\'') d", 'e("\\"") f') == [
        "a( );", "a b", "c( ) d", "e( ) f"]
    assert mask("python", 'a = """x " # \n""" + b # c', "'it''s' # \"", "r = 'a' 'b' c") == [
        "a = + b", "", "r = c"]
    assert mask("javascript", "a = `x ${`y`}` b", "x / y / z", "r = /['\"]/g; s", "a /* open") == [
        "a = y b", "x / y / z", "r = g; s", "a"]
    assert mask("go", "a := `x\n\"y` + \"z\" // c") == ["a := +"]
    assert mask("ruby", "a = '#' # b\n=begin\nx\n=end y\nc") == ["a = c"]
    assert mask("csharp", '@"a""b\n" + "c" /* d */ + e') == ["+ + e"]


def test_comments_only(spark):
    strip = lambda lang, *v: squeeze(apply(spark, text.strip_comments(F.col("t"), lang), *v))
    assert strip("javascript", "a('//x') // y", "b(\"/*\") /* c */ d") == ["a('//x' )", 'b("/*" ) d']
    assert strip("go", "import \"net/http\" // \"x\"") == ['import "net/http"']


def test_normalise(spark):
    got = apply(spark, text.normalise_source(F.col("t")),
                "﻿a\r\nb\rc", "x y’“z”", "p\x00\x07\tq\x85")
    assert got == ["a\nb\nc", "x\ny'\"z\"", "p\tq"]



def test_sql_literal_round_trip(spark):
    for value in ("it's", "a\\b'c\\", '"x"', "'", "", "\\n", "é\n'"):
        assert spark.sql(f"SELECT {text.sql_text(value)}").first()[0] == value
