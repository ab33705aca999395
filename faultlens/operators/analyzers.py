"""Analyzers of one's own, per language.

An analyzer is a function of the ``content`` column. It returns either a label
or a struct ``(basic boolean, advanced boolean, patterns map<string,boolean>,
libraries array<string>)``; null means it failed on that file. It may be any
Column expression; if Python is unavoidable, a pandas UDF.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.catalogs import domain
from faultlens.functions import scalars
from faultlens.operators.signals import classify_files

RESULT = ("struct<basic:boolean,advanced:boolean,patterns:map<string,boolean>,"
          "libraries:array<string>>")


def _as_result(output: Column, is_label: bool) -> Column:
    if not is_label:
        return output.cast(RESULT)
    return F.when(output.isNotNull(), F.struct(
        output.isin("Basic", "Mixed").alias("basic"),
        output.isin("Advanced", "Mixed").alias("advanced"),
        F.lit(None).cast("map<string,boolean>").alias("patterns"),
        F.lit(None).cast("array<string>").alias("libraries"),
    ))


def classify_with(files: DataFrame, analyzers: dict[str, Callable[[Column], Column]],
                  languages=domain.LANGUAGES, **options) -> DataFrame:
    """``classify_files`` with some languages' signals found by own analyzers.

    HTTP libraries still come from the built-in detector. One pass: an
    analyzer sees null for files of other languages.
    """
    language = F.col("language")
    results, own = [], []
    for i, (name, analyze) in enumerate(analyzers.items()):
        output = analyze(F.when(language == name, F.col("content")))
        own.append(output.alias(f"_own_{i}"))
    prepared = files.select("*", *own)
    for i, name in enumerate(analyzers):
        is_label = isinstance(prepared.schema[f"_own_{i}"].dataType, T.StringType)
        results.append(F.when(language == name, _as_result(F.col(f"_own_{i}"), is_label)))
    prepared = prepared.withColumn(
        "_own", F.coalesce(*results)).drop(*[f"_own_{i}" for i in range(len(own))])

    every = tuple(dict.fromkeys([*languages, *analyzers]))
    out = classify_files(prepared, languages=every, **options)
    mine = language.isin(*analyzers)
    no_names = F.array().cast("array<string>")
    flags = F.map_keys(F.map_filter(F.col("_own.patterns"), lambda _, v: v))

    def replaced(column: str, value: Column) -> Column:
        return F.when(mine, value).otherwise(F.col(column)).alias(column)

    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    new = {
        "parse_status": F.when(F.col("_own").isNull(), "failed").otherwise(
            F.col("parse_status")),
        "basic": yes("_own.basic"),
        "advanced": yes("_own.advanced"),
        "flags": F.coalesce(F.array_sort(flags), no_names),
        "resilience_libraries": F.coalesce(F.array_sort(F.array_distinct("_own.libraries")),
                                           no_names),
        "label": scalars.file_label(yes("_own.basic"), yes("_own.advanced")),
    }
    return out.select(*(
        replaced(c, new[c]) if c in new else F.col(c) for c in out.columns if c != "_own"))
