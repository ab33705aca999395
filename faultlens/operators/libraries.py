"""Import paths against catalogs, as joins on DataFrames.

For catalogs kept as tables of any size. No mode compares every path with every pattern:
an exact match is an equi-join; prefixes are found as ranges of sorted paths, and
fragments by an automaton over the patterns that reads each path once. For the last two,
distinct paths are dealt to lots, and each lot meets the patterns that can match there;
a lot is what one shuffle partition holds.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.shipping import ship_package

_SALTS = 64


def _root(path: Column, separator: str) -> Column:
    return F.substring_index(path, separator, 1)


def _per_distinct_path(imports: DataFrame, catalog: DataFrame, keys: Column, heads: Column
                       ) -> DataFrame:
    """Match every distinct path once, on any key both sides compute, then
    return to the imports. Popular paths shrink to one row before keys are
    spread out; the joins are left to Spark, which broadcasts a side only if
    its measured size allows and splits skewed partitions otherwise."""
    paths = imports.select("path").where(F.col("path").isNotNull()).distinct()
    keyed = paths.select("path", F.explode(keys).alias("_key"))
    matched = keyed.join(catalog.withColumn("_key", heads), "_key").drop("_key")
    return imports.join(matched, "path")


def match_exact(imports: DataFrame, catalog: DataFrame, separator: str | None = None) -> DataFrame:
    """Whole path, and with a ``separator`` its root segment too."""
    keys = F.array(F.col("path")) if separator is None else F.array_distinct(
        F.array("path", _root(F.col("path"), separator)))
    return _per_distinct_path(imports, catalog, keys, F.col("pattern"))


def _in_lots(imports: DataFrame, catalog: DataFrame, shard, match, shards: int = 1) -> DataFrame:
    """Distinct paths against patterns, lot by lot. ``shard`` gives the shards of a path
    (as an array) and of a pattern; ``match(paths, patterns)`` gives the numbers of the
    rows that match, as two lists."""
    import pyarrow as pa

    spark = imports.sparkSession
    ship_package(spark)
    lots = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // shards)
    paths = imports.select("path").where(F.col("path").isNotNull()).distinct().select(
        "path", F.explode(shard[0]).alias("_shard"), F.pmod(F.xxhash64("path"), F.lit(lots)).alias("_lot"))
    patterns = catalog.where(F.length("pattern") > 0).select(
        *catalog.columns, shard[1].alias("_shard"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long"))).alias("_lot"))
    columns = catalog.columns

    def matched(left: pa.Table, right: pa.Table) -> pa.Table:
        found = match(left.column("path").to_pylist(), right.column("pattern").to_pylist())
        rows, of = (pa.array(x, pa.int64()) for x in found)
        table = right.select(columns).take(of)
        return table.append_column("path", left.column("path").take(rows))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in catalog.schema)
    hits = paths.groupBy("_shard", "_lot").cogroup(patterns.groupBy("_shard", "_lot")).applyInArrow(
        matched, f"{kinds}, path string")
    return imports.join(hits, "path")


def prefix_ranges(paths: list[str], patterns: list[str]) -> tuple[list[int], list[int]]:
    """Paths that start with a pattern are neighbours once sorted: two binary searches a pattern."""
    order = sorted(range(len(paths)), key=lambda i: paths[i].encode())
    keys = [paths[i].encode() for i in order]
    rows, of = [], []
    for k, pattern in enumerate(patterns):
        low = bisect_left(keys, pattern.encode())
        high = bisect_left(keys, pattern.encode() + b"\xff", low)
        rows += order[low:high]
        of += [k] * (high - low)
    return rows, of


class Automaton:
    """Where to go on from each prefix of the patterns, by character; where else, if the
    path does not go on there; and the patterns that end there."""

    def __init__(self, patterns: list[str]):
        self.goto: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for k, pattern in enumerate(patterns):
            state = 0
            for c in pattern:
                if c not in self.goto[state]:
                    self.goto[state][c] = len(self.goto)
                    self.goto.append({})
                    self.ends.append([])
                state = self.goto[state][c]
            self.ends[state].append(k)
        #: The longest proper suffix that is a prefix, too, and the nearest such with an end.
        self.fail = [0] * len(self.goto)
        self.also = [0] * len(self.goto)
        waiting = deque(self.goto[0].values())
        while waiting:
            state = waiting.popleft()
            back = self.fail[state]
            self.also[state] = back if self.ends[back] else self.also[back]
            for c, after in self.goto[state].items():
                self.fail[after] = self.step(back, c)
                waiting.append(after)

    def step(self, state: int, c: str) -> int:
        while state and c not in self.goto[state]:
            state = self.fail[state]
        return self.goto[state].get(c, 0)

    def found(self, path: str) -> set[int]:
        state, seen, out = 0, set(), set()
        for c in path:
            state = self.step(state, c)
            at = state if self.ends[state] else self.also[state]
            # Past a state that was met before, everything is known.
            while at and at not in seen:
                seen.add(at)
                out.update(self.ends[at])
                at = self.also[at]
        return out


def fragments(paths: list[str], patterns: list[str]) -> tuple[list[int], list[int]]:
    automaton = Automaton(patterns)
    rows, of = [], []
    for i, path in enumerate(paths):
        hits = automaton.found(path)
        rows += [i] * len(hits)
        of += hits
    return rows, of


def match_prefix(imports: DataFrame, catalog: DataFrame) -> DataFrame:
    """Path starts with pattern: both have the same first character, and within it the
    matches of a pattern are a range of the sorted paths."""
    first = F.substring("path", 1, 1)
    return _in_lots(imports, catalog, (F.array(first), F.substring("pattern", 1, 1)), prefix_ranges, 8)


def match_first_segment(imports: DataFrame, catalog: DataFrame, separator: str = ".") -> DataFrame:
    """Path starts with the first segment of the pattern."""
    keyed = catalog.withColumn("_pattern", F.col("pattern")).withColumn(
        "pattern", _root(F.col("pattern"), separator))
    return match_prefix(imports, keyed).drop("pattern").withColumnRenamed("_pattern", "pattern")


def match_contains(imports: DataFrame, catalog: DataFrame, shards: int = 1) -> DataFrame:
    """Path contains pattern: an automaton over the patterns reads each path once. Where
    the patterns are too many for one automaton a task, ``shards`` parts them by their
    first characters, and a path goes to the shards of its characters."""
    def of(first: Column) -> Column:
        return F.pmod(F.xxhash64(first), F.lit(shards))

    own = F.array_distinct(F.transform(F.split("path", ""), of)) if shards > 1 else F.array(F.lit(0).cast("long"))
    other = of(F.substring("pattern", 1, 1)) if shards > 1 else F.lit(0).cast("long")
    return _in_lots(imports, catalog, (own, other), fragments, shards)


def require_substring(matches: DataFrame) -> DataFrame:
    """Secondary test of a catalog row: null asks for nothing."""
    needed = F.col("requires_substring")
    return matches.where(needed.isNull() | F.col("path").contains(needed))


def expand_flags(matches: DataFrame, resilience: DataFrame) -> DataFrame:
    """Library to the flags it implies, one row each."""
    return matches.join(resilience, "library").withColumn("flag", F.explode("flags"))


def library_catalog(results: DataFrame) -> DataFrame:
    """Repositories per library and their share of all repositories.

    ``results`` has one row per repository. The total rides along as one extra
    group of the same map-side-combined count, so the input is read once.
    """
    everything = F.array(F.lit(None).cast("string"))
    counted = results.select(
        F.explode(F.concat(F.array_distinct("http_libraries"), everything)).alias("library")
    ).groupBy("library").agg(F.count("*").alias("repo_count"))
    # Every share needs the total. Its row is copied to each of a few salts
    # and meets the libraries there, so no one task sees the whole catalog.
    salts = F.when(F.col("library").isNull(), F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(
        F.array(F.pmod(F.hash("library"), F.lit(_SALTS))))
    total = F.max(F.when(F.col("library").isNull(), F.col("repo_count"))).over(
        Window.partitionBy("_salt"))
    return counted.withColumn("_salt", F.explode(salts)).withColumn("_total", total).where(
        F.col("library").isNotNull()).select(
        "library", "repo_count",
        F.try_divide(F.col("repo_count") * 100.0, F.col("_total")).alias("repo_pct"))


def catalog_order(catalog: DataFrame, k: int | None = None) -> DataFrame:
    """Most used first, then by name regardless of case; optionally the top k."""
    ordered = catalog.orderBy(F.desc("repo_count"), F.lower("library"), "library")
    return ordered if k is None else ordered.limit(k)


def library_coverage(results: DataFrame) -> DataFrame:
    """Repositories with and without a library, and libraries seen."""
    libraries = F.col("http_libraries")
    per_library = results.select(
        F.explode(F.concat(libraries, F.array(F.lit(None).cast("string")))).alias("library"),
        F.size(libraries).alias("_size"),
    ).groupBy("library").agg(
        F.count("*").alias("n"), F.count_if(F.col("_size") > 0).alias("n_with"))
    everything = F.col("library").isNull()
    return per_library.agg(
        F.max(F.when(everything, F.col("n"))).alias("n_repos"),
        F.max(F.when(everything, F.col("n_with"))).alias("with_library"),
        F.count("library").alias("n_libraries"),
        F.coalesce(F.sum(F.when(~everything, F.col("n"))), F.lit(0)).alias("n_pairs"),
    ).select("n_repos", "with_library",
             (F.col("n_repos") - F.col("with_library")).alias("without_library"),
             "n_libraries", "n_pairs")


def language_cooccurrence(results: DataFrame) -> DataFrame:
    """Repositories per (library, language of the repository)."""
    return results.select(
        F.explode("http_libraries").alias("library"), "languages"
    ).select("library", F.explode("languages").alias("language")).groupBy(
        "library", "language").agg(F.count("*").alias("n"))


def top_languages(cooccurrence: DataFrame, k: int = 3) -> DataFrame:
    """The k languages a library most often meets, as ``name (n); ...``."""
    ranked = cooccurrence.withColumn("_rank", F.row_number().over(
        Window.partitionBy("library").orderBy(F.desc("n"), "language")))
    entry = F.struct("_rank", F.concat("language", F.lit(" ("), F.col("n"), F.lit(")")).alias("t"))
    return ranked.where(F.col("_rank") <= k).groupBy("library").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["t"]), "; ")
        .alias("top_languages"))
