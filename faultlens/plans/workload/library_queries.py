"""Catalog joins on import paths, and library statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.functions import scalars
from faultlens.operators import libraries
from faultlens.plans.workload import tables
from faultlens.plans.workload.registry import query

_H = """h AS (SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS language,
    regexp_extract_all(html, 'href="/([^"]*)"', 1) AS paths FROM pages),
i AS (SELECT page_id, language, unnest(paths) AS path FROM h)"""


_WORDS = """w AS (SELECT DISTINCT unnest(
    regexp_extract_all(lower(text), '([a-z]+)', 1)) AS pattern FROM benchmark)"""


def _imports(spark, sf_dir):
    return tables.page_imports(spark, sf_dir).select(
        "page_id", "language", F.explode("paths").alias("path"))


@query("library_exact", f"""WITH {_H}, {_WORDS} SELECT page_id, path, pattern
FROM i JOIN w ON pattern = path OR pattern = split_part(path, '.', 1)""")
def library_exact(spark, sf_dir):
    return libraries.match_exact(
        _imports(spark, sf_dir), tables.benchmark_words(spark, sf_dir), "."
    ).select("page_id", "path", "pattern")


@query("library_prefix", f"""WITH {_H}, {_WORDS} SELECT page_id, path, pattern
FROM i JOIN w ON starts_with(path, pattern)""")
def library_prefix(spark, sf_dir):
    return libraries.match_prefix(
        _imports(spark, sf_dir), tables.benchmark_words(spark, sf_dir)
    ).select("page_id", "path", "pattern")


@query("library_contains", f"""WITH {_H}, {_WORDS} SELECT page_id, path, pattern
FROM i JOIN w ON contains(path, pattern)""")
def library_contains(spark, sf_dir):
    return libraries.match_contains(
        _imports(spark, sf_dir), tables.benchmark_words(spark, sf_dir)
    ).select("page_id", "path", "pattern")


@query("library_first_segment", """WITH hosts AS (SELECT DISTINCT
    regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS pattern FROM pages),
w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '([a-z]+)', 1)) AS path
  FROM benchmark)
SELECT path, pattern FROM w JOIN hosts ON starts_with(path, split_part(pattern, '.', 1))""")
def library_first_segment(spark, sf_dir):
    hosts = tables.load(spark, sf_dir, "pages").select(
        scalars.url_host(F.col("url")).alias("pattern")).distinct()
    paths = tables.benchmark_words(spark, sf_dir).withColumnRenamed("pattern", "path")
    return libraries.match_first_segment(paths, hosts).select("path", "pattern")


@query("library_requires_substring", f"""WITH {_H}, {_WORDS} SELECT page_id, path, pattern
FROM i JOIN w ON starts_with(path, pattern)
WHERE length(pattern) % 2 = 0 OR contains(path, 'th')""")
def library_requires_substring(spark, sf_dir):
    catalog = tables.benchmark_words(spark, sf_dir).withColumn(
        "requires_substring", F.when(F.length("pattern") % 2 == 1, "th"))
    matches = libraries.match_prefix(_imports(spark, sf_dir), catalog)
    return libraries.require_substring(matches).select("page_id", "path", "pattern")


@query("library_flags", f"""WITH {_H}, {_WORDS}
SELECT page_id, path, library, flag FROM (SELECT page_id, path, pattern AS library,
  unnest(list_distinct([substr(pattern, 1, 1), right(pattern, 1)])) AS flag
  FROM i JOIN w ON pattern = path)""")
def library_flags(spark, sf_dir):
    words = tables.benchmark_words(spark, sf_dir)
    flags = words.select(F.col("pattern").alias("library"), F.array_distinct(F.array(
        F.substring("pattern", 1, 1), F.right("pattern", F.lit(1)))).alias("flags"))
    matches = libraries.match_exact(_imports(spark, sf_dir), words).withColumnRenamed(
        "pattern", "library")
    return libraries.expand_flags(matches, flags).select("page_id", "path", "library", "flag")


_CATALOG = f"""{_H}, l AS (SELECT DISTINCT page_id, language, path AS library FROM i),
cat AS (SELECT library, count(*) AS repo_count,
  100.0::DOUBLE * count(*) / (SELECT count(*) FROM pages) AS repo_pct FROM l GROUP BY library)"""


def _catalog(spark, sf_dir):
    return libraries.library_catalog(tables.page_results(spark, sf_dir))


@query("library_catalog", f"""WITH {_CATALOG}
SELECT library, repo_count, round(repo_pct, 6) AS repo_pct FROM cat""")
def library_catalog(spark, sf_dir):
    return libraries.catalog_order(_catalog(spark, sf_dir)).withColumn(
        "repo_pct", F.round("repo_pct", 6))


@query("library_top20", f"""WITH {_CATALOG} SELECT library, repo_count FROM cat
ORDER BY repo_count DESC, lower(library), library LIMIT 20""")
def library_top20(spark, sf_dir):
    return libraries.catalog_order(_catalog(spark, sf_dir), 20).select("library", "repo_count")


@query("library_coverage", f"""WITH {_CATALOG}
SELECT (SELECT count(*) FROM pages) AS n_repos, count(DISTINCT page_id) AS with_library,
  (SELECT count(*) FROM pages) - count(DISTINCT page_id) AS without_library,
  count(DISTINCT library) AS n_libraries, count(*) AS n_pairs FROM l""")
def library_coverage(spark, sf_dir):
    return libraries.library_coverage(tables.page_results(spark, sf_dir))


@query("library_languages", f"""WITH {_CATALOG}
SELECT library, language, count(*) AS n FROM l GROUP BY ALL""")
def library_languages(spark, sf_dir):
    return libraries.language_cooccurrence(tables.page_results(spark, sf_dir))


@query("library_top3_languages", f"""WITH {_CATALOG},
n AS (SELECT library, language, count(*) AS n FROM l GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY library ORDER BY n DESC, language) AS k FROM n)
SELECT library, string_agg(language || ' (' || n || ')', '; ' ORDER BY k) AS top_languages
FROM r WHERE k <= 3 GROUP BY library""")
def library_top3_languages(spark, sf_dir):
    return libraries.top_languages(
        libraries.language_cooccurrence(tables.page_results(spark, sf_dir)))


@query("distinct_sets", f"""WITH {_H} SELECT page_id, len(list_distinct(paths)) AS n,
  array_to_string(list_sort(list_distinct(paths)), ';') AS libraries FROM h""")
def distinct_sets(spark, sf_dir):
    names = F.array_sort(F.array_distinct("paths"))
    return tables.page_imports(spark, sf_dir).select(
        "page_id", F.size(names).cast("bigint").alias("n"),
        F.array_join(names, ";").alias("libraries"))
