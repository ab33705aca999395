"""Detection on source files, per language and end to end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultlens.catalogs import domain
from faultlens.operators import adoption, contingency, libraries
from faultlens.operators.analyzers import classify_with
from faultlens.operators.rollup import flag_counts, rendered
from faultlens.operators.signals import classify_files, detect_http_libraries, detect_signals
from faultlens.plans.scan import scan_corpus
from faultlens.plans.workload import source_sql as sql
from faultlens.plans.workload import tables
from faultlens.plans.workload.registry import query
from faultlens.functions import scalars


def joined(names: str) -> Column:
    return F.array_join(F.array_sort(F.col(names)), ";").alias(names)


def _register(language: str) -> None:
    @query(f"libraries_{language}", sql.libraries_sql(language))
    def libraries_of(spark, sf_dir):
        files = tables.source_files(spark, sf_dir, language)
        found = detect_http_libraries(files, languages=(language,))
        return found.select("doc_id", joined("http_libraries"), "has_http_library")

    @query(f"signals_{language}", sql.signals_sql(language))
    def signals_of(spark, sf_dir):
        files = tables.source_files(spark, sf_dir, language)
        found = detect_signals(files, languages=(language,))
        return found.select("doc_id", "label", joined("flags"), joined("resilience_libraries"))


for _language in domain.LANGUAGES:
    _register(_language)


@query("signals_python_exact", sql.signals_sql("python"))
def signals_python_exact(spark, sf_dir):
    """The standard parser's facts under the same rules."""
    files = tables.source_files(spark, sf_dir, "python")
    found = detect_signals(files, languages=("python",), exact_python=True)
    return found.select("doc_id", "label", joined("flags"), joined("resilience_libraries"))


@query("signals_php", sql.signals_sql("php"))
def signals_php(spark, sf_dir):
    files = tables.source_files(spark, sf_dir, "php")
    found = detect_signals(files, languages=("php",), libraries=())
    return found.select("doc_id", "label", joined("flags"), joined("resilience_libraries"))


@query("own_analyzer", f"""WITH {sql.source_cte("go")}
SELECT doc_id, CASE WHEN contains(raw, 'recover') THEN 'Advanced' WHEN contains(raw, 'err')
    THEN 'Basic' ELSE 'None' END AS label,
  CASE WHEN contains(raw, 'recover') THEN 'recovers' ELSE '' END AS flags FROM src""")
def own_analyzer(spark, sf_dir):
    def analyze(content: Column) -> Column:
        recovers = content.contains("recover")
        return F.when(content.isNotNull(), F.struct(
            (content.contains("err") & ~recovers).alias("basic"), recovers.alias("advanced"),
            F.create_map(F.lit("recovers"), recovers).alias("patterns"),
            F.array().cast("array<string>").alias("libraries")))

    found = classify_with(tables.source_files(spark, sf_dir, "go"), {"go": analyze},
                          languages=("go",), libraries=())
    return found.select("doc_id", "label", joined("flags"))


_HAS = [("backoff" if f == "exponential_backoff" else f, f) for f in domain.CORE_FLAGS]


@query("corpus_scan", f"""WITH {sql.scan_cte()}
SELECT repo_url, exception_type, languages, http_libraries, resilience_libraries,
  total_files, handled_files, 1.0::DOUBLE AS parser_success_rate,
  {', '.join(f'n_{flag} > 0 AS has_{name}' for name, flag in _HAS)},
  {', '.join(f'n_{flag}' for flag in domain.ALL_FLAGS)}
FROM repos""")
def corpus_scan(spark, sf_dir):
    results = scan_corpus(tables.source_files(spark, sf_dir))
    return results.select(
        "repo_url", "exception_type", joined("languages"), joined("http_libraries"),
        joined("resilience_libraries"), "total_files", "handled_files", "parser_success_rate",
        *(f"has_{name}" for name, _ in _HAS), *(f"n_{flag}" for flag in domain.ALL_FLAGS))


_RECOMMENDED = " ".join(
    f"WHEN {sql.quoted(k)} THEN {sql.quoted(v)}" for k, v in domain.RECOMMENDATION.items())


@query("corpus_rendered", f"""WITH {sql.scan_cte()}
SELECT repo_url, exception_type AS "Exception Type",
  CASE exception_type {_RECOMMENDED} END AS "Recommendation",
  replace(languages, ';', '; ') AS "Languages",
  CASE WHEN http_libraries = '' THEN 'None detected' ELSE replace(http_libraries, ';', '; ') END
    AS "HTTP Libraries", '100.00%' AS "Parser Success Rate",
  {', '.join(f'n_{flag} > 0 AS "Has {title}"' for flag, title in domain.CORE_FLAGS.items())}
FROM repos""")
def corpus_rendered(spark, sf_dir):
    return rendered(scan_corpus(tables.source_files(spark, sf_dir)))


@query("corpus_flag_counts", f"""WITH {sql.scan_cte()}
SELECT repo_url, flag, count(*) AS n_files
FROM (SELECT repo_url, unnest(flag_list) AS flag FROM files) GROUP BY ALL""")
def corpus_flag_counts(spark, sf_dir):
    return flag_counts(classify_files(tables.source_files(spark, sf_dir)))


_GROUP = "CASE WHEN contains(languages, ';') THEN 'Multiple' ELSE CASE languages " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in domain.LANGUAGE_DISPLAY.items()
) + " END END"


@query("corpus_contingency", f"""WITH {sql.scan_cte()},
grouped AS (SELECT {_GROUP} AS row_key, exception_type FROM repos)
SELECT row_key, col_key, count(*) FILTER (exception_type = col_key) AS n
FROM grouped, (VALUES ('None'), ('Basic'), ('Mixed'), ('Advanced')) c(col_key) GROUP BY ALL""")
def corpus_contingency(spark, sf_dir):
    results = scan_corpus(tables.source_files(spark, sf_dir)).withColumn(
        "language", scalars.language_group(F.col("languages")))
    return contingency.contingency(results, "language", "exception_type", domain.CATEGORIES)


@query("corpus_adoption", f"""WITH {sql.scan_cte()},
counts AS (SELECT {_GROUP} AS language, count(*) AS total_repos,
  {', '.join(f'count(*) FILTER (n_{flag} > 0) AS {name}' for name, flag in _HAS)}
  FROM repos GROUP BY 1)
SELECT language, pattern, n_repos, round(100.0::DOUBLE * n_repos / total_repos, 1) AS pct
FROM (UNPIVOT counts ON {', '.join(name for name, _ in _HAS)} INTO NAME pattern VALUE n_repos)""")
def corpus_adoption(spark, sf_dir):
    counts = adoption.pattern_counts(scan_corpus(tables.source_files(spark, sf_dir)))
    return adoption.adoption_by_language(counts).select("language", "pattern", "n_repos", "pct")


@query("corpus_library_catalog", f"""WITH {sql.scan_cte()},
total AS (SELECT count(*) AS n FROM repos)
SELECT library, count(*) AS repo_count, round(100.0::DOUBLE * count(*) / any_value(n), 6) AS repo_pct
FROM (SELECT unnest(string_split(http_libraries, ';')) AS library FROM repos
      WHERE http_libraries <> ''), total GROUP BY library""")
def corpus_library_catalog(spark, sf_dir):
    catalog = libraries.library_catalog(scan_corpus(tables.source_files(spark, sf_dir)))
    return libraries.catalog_order(catalog).withColumn("repo_pct", F.round("repo_pct", 6))
