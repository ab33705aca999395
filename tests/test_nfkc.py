"""Compatibility normalisation against the character database's own."""

import random
import sys
import unicodedata

from pyspark.sql import functions as F

from faultlens.functions import nfkc as nfkc_module
from faultlens.functions.nfkc import nfkc
from faultlens.functions.text import normalise_source


def normalised(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8)
    found = {r.i: r.n for r in rows.select("i", nfkc(F.col("t")).alias("n")).collect()}
    return [found[i] for i in range(len(texts))]


def wrong(texts, found):
    return [(t, n) for t, n in zip(texts, found) if n != unicodedata.normalize("NFKC", t)]


def test_every_character(spark):
    points = [p for p in range(1, sys.maxunicode + 1) if not 0xD800 <= p < 0xE000
              and (unicodedata.normalize("NFKC", chr(p)) != chr(p) or unicodedata.combining(chr(p)) or p % 97 == 0)]
    texts = ["x".join(map(chr, points[i:i + 40])) for i in range(0, len(points), 40)]
    assert wrong(texts, normalised(spark, texts)) == []


def test_sequences(spark):
    choose = random.Random(6)
    marks = [chr(p) for p in range(0x300, 0x370)] + ["̧", "̣", "ְ", "゙", "゚", "ཱ", "ི"]
    letters = list("aeioucnszAEO ") + ["é", "ç", "ǖ", "ḍ", "ộ", "ﬁ", "Å", "㎞", "½", "か", "ハ", "ｶ", "ﾞ", "각", "가", "한"]
    jamo = [chr(0x1100 + choose.randrange(19)) for _ in range(8)] + [chr(0x1161 + choose.randrange(21)) for _ in range(8)] + [
        chr(0x11A8 + choose.randrange(27)) for _ in range(8)]
    texts = ["".join(choose.choice(choose.choice([letters, letters, marks, jamo])) for _ in range(choose.randrange(12)))
             for _ in range(4000)]
    assert wrong(texts, normalised(spark, texts)) == []


def test_plain_long_and_missing_texts(spark):
    texts = ["", "plain", "déjà vu " * 20_000, "ﬁ" * 20_000, "é" * 20_000, "a" * 100_000 + "́"]
    assert wrong(texts, normalised(spark, texts)) == []
    assert spark.createDataFrame([(None,)], "t string").select(nfkc(F.col("t"))).first()[0] is None


def test_single_characters_are_looked_up(spark):
    """Each character that may change between and behind letters of many kinds, and doubled."""
    points = [p for p in nfkc_module._unsettled() if p % 7 == 0 or p in nfkc_module._joining()]
    texts = [f"{a}{chr(p)}{b}" for p in points for a, b in (("e", "x"), ("", "ü"), ("ü", ""), ("\u1100", "\u1161"))]
    texts += [f"x{chr(p)}{chr(q)}" for p, q in zip(points, points[1:])] + ["ｅ\u0301ｂ", "\x02\u0301", "ﬁ\u0301", "か\u3099\u0323"]
    assert wrong(texts, normalised(spark, texts)) == []
    # Where the text has no run of several such characters, no run is worked on one by one.
    alone = nfkc_module._alone()
    assert alone[0xFB01] == "fi" and "eé" in alone[0x301] and 0x1161 not in alone
    assert dict(zip(*nfkc_module._replaced()))["ｂ"] == "b"


def test_no_python_at_run_time(spark):
    frame = spark.range(1).select(nfkc(F.col("id").cast("string")))
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()


def test_source_text(spark):
    text = "﻿ｔｒｙ:\r\n  x = “ﬁle” y = ’é’ 한\x07\n"
    rows = spark.createDataFrame([(text,)], "t string")
    assert rows.select(normalise_source(F.col("t"))).first()[0] == "try:\n  x = \"file\"\ny = 'é' 한\n"
