"""File signals to one row per repository.

Every state is small and mergeable - counters, booleans, bit sets over listed names
and the label of the smallest path - so a repository that holds a third of all files
still sends one partial row per map task. Names that are not listed go along as rows of
their own (repository, name), which are combined before the shuffle like the rest: a
task holds each distinct name once, however many files have it and in whatever
combination. A second, small shuffle brings a repository's names to its row. Partials can also be stored and merged later (see
``faultlens.streaming``); they carry the version of the lists their bits follow.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.catalogs import domain
from faultlens.catalogs.http_libraries import http_library_names
from faultlens.catalogs.resilience_libraries import resilience_library_names
from faultlens.functions import scalars
from faultlens.functions.text import sql_text
from faultlens.operators.signals import canonical_flags

_WORD = 62


@dataclass(frozen=True)
class Domains:
    """Names that are kept as bits; their order is the bit order of stored
    partials. Other names are kept, too, as text."""

    languages: tuple[str, ...] = domain.LANGUAGES
    http_libraries: tuple[str, ...] = field(default_factory=lambda: tuple(http_library_names()))
    resilience_libraries: tuple[str, ...] = field(
        default_factory=lambda: tuple(resilience_library_names()))
    flags: tuple[str, ...] = domain.ALL_FLAGS

    def sets(self) -> dict[str, tuple[str, ...]]:
        return {
            "languages": self.languages,
            "http_libraries": self.http_libraries,
            "resilience_libraries": self.resilience_libraries,
        }

    @property
    def version(self) -> str:
        """Changes with any list, so that bits are never read by another list."""
        lists = [*self.sets().values(), self.flags]
        return hashlib.sha1(json.dumps(lists).encode()).hexdigest()[:16]


def _words(names: tuple[str, ...]) -> list[tuple[str, ...]]:
    return [names[i:i + _WORD] for i in range(0, len(names), _WORD)]


def _encode(values: str, names: tuple[str, ...]) -> Column:
    """Array of names (as SQL) to one ``bigint`` of bits."""
    table = ", ".join(f"{sql_text(name)}, {1 << i}L" for i, name in enumerate(names))
    return F.expr(f"aggregate({values}, 0L, (bits, name) -> "
                  f"bits | coalesce(try_element_at(map({table}), name), 0L))")


def _unlisted(kind: str, values: str, names: tuple[str, ...]) -> str:
    """SQL: the names outside the list, marked with their kind."""
    table = ", ".join(map(sql_text, names))
    return (f"transform(filter({values}, name -> NOT array_contains(array({table}), name)), "
            f"name -> concat({sql_text(kind + ':')}, name))")


def _of_kind(kind: str) -> Column:
    start = f"{kind}:"
    return F.transform(F.filter("unlisted", lambda n: n.startswith(start)),
                       lambda n: F.substring(n, len(start) + 1, 1 << 30))


def _set_names(names: tuple[str, ...], bits: str) -> Column:
    table = ", ".join(map(sql_text, names))
    return F.expr(f"CASE WHEN {bits} = 0L THEN CAST(array() AS array<string>) "
                  f"ELSE filter(array({table}), (name, i) -> getbit({bits}, i) = 1) END")


def _decode(words: list[tuple[tuple[str, ...], str]]) -> Column:
    return F.array_sort(F.concat(*(_set_names(names, bits) for names, bits in words)))


def _folded(rows: DataFrame, by: list[str], unlisted: str, states: list[Column]) -> DataFrame:
    """``states`` per group, and the sorted distinct names of the arrays ``unlisted``.

    A row stands for itself, without a name, and once more for each of its names.
    """
    itself = F.array(F.lit(None).cast("string"))
    names = F.concat(itself, F.coalesce(unlisted, F.array().cast("array<string>")))
    once = rows.withColumn("_name", F.explode(names)).groupBy(*by, "_name").agg(*states)
    kept = [c for c in once.columns if c not in (*by, "_name")]
    # One row of a group is without a name and has the group's state.
    state = F.when(F.col("_name").isNull(), F.struct(*kept))
    return once.groupBy(*by).agg(
        F.first(state, ignorenulls=True).alias("_state"),
        F.array_sort(F.collect_list("_name")).alias("unlisted"),
    ).select(*by, "_state.*", "unlisted")


def partial_rollup(
    signals: DataFrame,
    by=("repo_url",),
    domains: Domains | None = None,
    order: str = "path",
    canonical: bool = True,
) -> DataFrame:
    """Mergeable state per group. ``order`` defines which file is first.

    A file counts as failed when it could not be analysed: it has no label and no
    flags, but its language (unless unreadable) and HTTP libraries still count.
    ``canonical`` files native error handling
    (``rescue``, ``do``/``catch``, error checks) under ``try_catch`` as well.
    """
    domains = domains or Domains()
    by = list(by)
    analysed = F.col("parse_status") != "failed"
    label = F.when(analysed & (F.col("label") != "None"), F.col("label"))
    language = "array(language)"
    if "decode_ok" in signals.columns:
        language = "CASE WHEN coalesce(decode_ok, true) THEN array(language) ELSE array() END"
    flags = canonical_flags(F.col("flags")) if canonical else F.col("flags")
    present = signals.columns
    others = [
        _unlisted(column, language if column == "languages" else column, names)
        for column, names in domains.sets().items() if column == "languages" or column in present]
    others.append(_unlisted("flags", "_flags", domains.flags))

    no_flags = F.array().cast("array<string>")
    slim = signals.withColumn("_flags", F.when(analysed, flags).otherwise(no_flags)).select(
        *by,
        F.when(label.isNotNull(), F.col(order)).alias("_order"),
        label.alias("_label"),
        (F.col("parse_status") == "failed").alias("_failed"),
        (label == "Basic").alias("_is_basic"),
        (label == "Advanced").alias("_is_advanced"),
        (analysed & F.col("basic")).alias("basic"),
        (analysed & F.col("advanced")).alias("advanced"),
        "_flags",
        F.expr(f"nullif(concat({', '.join(others)}), CAST(array() AS array<string>))")
        .alias("_unlisted"),
        *(
            _encode(
                language if column == "languages" else column, word).alias(f"{column}_{i}")
            for column, names in domains.sets().items()
            if column == "languages" or column in present
            for i, word in enumerate(_words(names))
        ),
    )
    sets = [c for c in slim.columns if c not in by and c.rsplit("_", 1)[-1].isdigit()]
    return _folded(slim, by, "_unlisted", [
        F.count("*").alias("total_files"),
        F.count_if("_failed").alias("failed_files"),
        F.count("_label").alias("handled_files"),
        F.min("_order").alias("first_order"),
        F.min_by("_label", "_order").alias("first_label"),
        F.max(F.coalesce("_is_basic", F.lit(False))).alias("any_basic_label"),
        F.max(F.coalesce("_is_advanced", F.lit(False))).alias("any_advanced_label"),
        F.max("basic").alias("any_basic"),
        F.max("advanced").alias("any_advanced"),
        *(F.bit_or(c).alias(c) for c in sets),
        *(F.expr(f"count_if(array_contains(_flags, {sql_text(flag)})) AS n_{flag}")
          for flag in domains.flags),
        F.lit(domains.version).alias("lists"),
    ])


def merge_partials(partials: DataFrame, by=("repo_url",)) -> DataFrame:
    """Fold partial states of disjoint file sets; associative."""
    by = list(by)
    columns = partials.columns
    sums = [c for c in columns if c in ("total_files", "failed_files", "handled_files")
            or c.startswith("n_")]
    anys = [c for c in columns if c.startswith("any_")]
    bits = [c for c in columns if c.rsplit("_", 1)[-1].isdigit()]
    merged = _folded(partials, by, "unlisted", [
        *(F.sum(c).alias(c) for c in sums),
        F.min("first_order").alias("first_order"),
        F.min_by("first_label", "first_order").alias("first_label"),
        *(F.max(c).alias(c) for c in anys),
        *(F.bit_or(c).alias(c) for c in bits),
        F.when(F.min("lists") == F.max("lists"), F.min("lists")).alias("lists"),
    ])
    return merged.select(*[c for c in columns if c in merged.columns])


def folded_label() -> Column:
    """Order-dependent fold over a partial's columns: the first label stands
    unless both a Basic and an Advanced file occur."""
    return (
        F.when(F.col("first_label").isNull(), "None")
        .when(F.col("any_basic_label") & F.col("any_advanced_label"), "Mixed")
        .otherwise(F.col("first_label"))
    )


def any_label() -> Column:
    """Order-free fold: what the files show between them."""
    return scalars.file_label(F.col("any_basic"), F.col("any_advanced"))


def finish_rollup(
    partials: DataFrame, by=("repo_url",), domains: Domains | None = None, fold: str = "ordered",
) -> DataFrame:
    """Typed repository rows from merged partials. Partials whose bits follow
    other lists than ``domains`` are an error."""
    domains = domains or Domains()
    exception_type = folded_label() if fold == "ordered" else any_label()
    total = F.when(F.col("lists") == domains.version, F.col("total_files")).otherwise(
        F.raise_error(F.lit("these partial states were written with other lists of names")))
    failed = F.col("failed_files")
    return partials.select(
        *by,
        exception_type.alias("exception_type"),
        scalars.recommendation(exception_type).alias("recommendation"),
        *(
            F.array_sort(F.concat(
                _decode([(word, f"{column}_{i}") for i, word in enumerate(_words(names))]),
                _of_kind(column))).alias(column)
            for column, names in domains.sets().items() if f"{column}_0" in partials.columns
        ),
        total.cast("bigint").alias("total_files"), "failed_files", "handled_files",
        success_rate(F.col("total_files"), failed).alias("parser_success_rate"),
        F.when(F.col("total_files") == 0, "no_files")
        .when(failed == F.col("total_files"), "all_failed").otherwise("ok")
        .alias("status"),
        *(
            F.expr(f"n_{flag} > 0 AS has_"
                   + ("backoff" if flag == "exponential_backoff" else flag))
            for flag in domain.CORE_FLAGS if flag in domains.flags
        ),
        *(f"n_{flag}" for flag in domains.flags),
        _of_kind("flags").alias("other_flags"),
    )


def success_rate(total: Column, failed: Column) -> Column:
    return F.when(total > 0, (total - failed) / total).otherwise(0.0)


def repo_results(signals: DataFrame, by=("repo_url",), domains: Domains | None = None,
                 order: str = "path", fold: str = "ordered", canonical: bool = True) -> DataFrame:
    """One row per repository from classified files."""
    return finish_rollup(
        partial_rollup(signals, by, domains, order, canonical), by, domains, fold)


def _key(repo: Column) -> Column:
    """Repository key of a URL; a folder's name is its key already."""
    return F.when(repo.contains("/"), scalars.repo_key(repo)).otherwise(repo)


def with_empty_repositories(results: DataFrame, repositories: DataFrame) -> DataFrame:
    """Add repositories without a single supported file (rate 0, ``no_files``).

    Both sides meet by repository key, so a list of URLs fits results that are
    named by folder; results of repositories that are not listed stay.
    """
    listed = repositories.select(
        F.col("repo_url").alias("_listed"), _key(F.col("repo_url")).alias("_key"),
    ).where(F.col("_listed").isNotNull()).dropDuplicates(["_key"])
    joined = (
        results.withColumn("_key", _key(F.col("repo_url")))
        .join(listed, "_key", "full")
        .withColumn("repo_url", F.coalesce("repo_url", "_listed"))
    )
    empty = F.array().cast("array<string>")
    fills = []
    for name, kind in results.dtypes:
        if name == "repo_url":
            continue
        default = {
            "exception_type": F.lit("None"), "status": F.lit("no_files"),
            "recommendation": F.lit(domain.RECOMMENDATION["None"]),
        }.get(name)
        if default is None:
            default = empty if kind.startswith("array") else F.lit(
                False if kind == "boolean" else 0).cast(kind)
        fills.append(F.coalesce(F.col(name), default).alias(name))
    return joined.select("repo_url", *fills)


def fold_labels(labelled: DataFrame, by, order: str, label: str = "label") -> DataFrame:
    """The ordered fold alone, over any table of labels."""
    known = F.when(F.col(label) != "None", F.col(label))
    return labelled.groupBy(*by).agg(
        F.min_by(known, F.when(known.isNotNull(), F.col(order))).alias("first_label"),
        F.max(F.coalesce(known == "Basic", F.lit(False))).alias("any_basic_label"),
        F.max(F.coalesce(known == "Advanced", F.lit(False))).alias("any_advanced_label"),
    ).select(*by, folded_label().alias("exception_type"))


def fold_labels_any(labelled: DataFrame, by, label: str = "label") -> DataFrame:
    """The order-free fold over any table of labels."""
    value = F.col(label)
    return labelled.groupBy(*by).agg(
        F.max(value.isin("Basic", "Mixed")).alias("any_basic"),
        F.max(value.isin("Advanced", "Mixed")).alias("any_advanced"),
    ).select(*by, any_label().alias("exception_type"))


def flag_counts(signals: DataFrame, by=("repo_url",)) -> DataFrame:
    """Files per (group, flag) in long form, whatever flags occur."""
    return (
        signals.select(*by, F.explode("flags").alias("flag"))
        .groupBy(*by, "flag").agg(F.count("*").alias("n_files"))
    )


def rendered(results: DataFrame) -> DataFrame:
    """The published 12-column text form."""
    titles = {flag: f"Has {title}" for flag, title in domain.CORE_FLAGS.items()}
    return results.select(
        "repo_url",
        F.col("exception_type").alias("Exception Type"),
        F.col("recommendation").alias("Recommendation"),
        F.array_join("languages", "; ").alias("Languages"),
        scalars.list_or_none(F.col("http_libraries")).alias("HTTP Libraries"),
        scalars.format_rate(F.col("parser_success_rate")).alias("Parser Success Rate"),
        *(
            F.col("has_" + ("backoff" if flag == "exponential_backoff" else flag)).alias(title)
            for flag, title in titles.items()
        ),
    )


def canonical_results(results: DataFrame) -> DataFrame:
    """Rows worth keeping: a repository that yielded none is dropped."""
    return results.where(F.col("repo_url").isNotNull() & F.col("exception_type").isNotNull())
