"""Projections and predicates on files, paths and URLs; surrogate signals."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from faultlens.catalogs import domain
from faultlens.functions import scalars, text
from faultlens.operators import adoption, contingency, relational, reports
from faultlens.operators.rollup import Domains, flag_counts, repo_results
from faultlens.operators.signals import classify_files, merge_flags
from faultlens.plans.workload import tables
from faultlens.plans.workload.registry import query
from faultlens.plans.workload.source_sql import quoted
from faultlens.session import checkpoint_dir, local_folder
from faultlens.sources.files import decoded, select_files
from faultlens.streaming.incremental import current_results, start_scan

FLAGS = tuple(domain.CORE_FLAGS)
PATTERNS = adoption.PATTERNS
DOMAINS = Domains(tables.DOCUMENT_LANGUAGES, (), (), FLAGS)


def classified(spark, sf_dir):
    """Documents as files under the surrogate rules. Every second source is a
    repository of several languages, the others are split by language."""
    files = tables.document_files(spark, sf_dir)
    even = F.substring("repo_url", 4, 10).cast("int") % 2 == 0
    files = files.withColumn("repo_url", F.when(even, F.col("repo_url")).otherwise(
        F.concat_ws("-", "repo_url", "language")))
    return classify_files(files, languages=tables.DOCUMENT_LANGUAGES,
                          rules=tables.SURROGATE_RULES, shapes=[], libraries=())


def results(spark, sf_dir):
    return repo_results(classified(spark, sf_dir), domains=DOMAINS)


_RULES = {r.flags[0]: r for r in tables.SURROGATE_RULES}
_SIGNALS = """signals AS (
  SELECT doc_id, lang AS language, text, n_chars,
    CASE WHEN CAST(substr(source, 4) AS INTEGER) % 2 = 0 THEN source
      ELSE source || '-' || lang END AS repo_url,
    """ + ",\n    ".join(
    f"regexp_matches(text, {quoted(rule.pattern)}) AS {flag}" for flag, rule in _RULES.items()
) + """ FROM documents),
labelled AS (SELECT *, try_catch OR status_check AS basic,
    timeout OR retry OR circuit_breaker AS advanced FROM signals),
files AS (SELECT *, CASE WHEN basic AND advanced THEN 'Mixed' WHEN advanced THEN 'Advanced'
    WHEN basic THEN 'Basic' ELSE 'None' END AS label FROM labelled)"""
_COUNTED = ", ".join(f"count(*) FILTER ({flag}) AS n_{flag}" for flag in _RULES)
_RESULTS = _SIGNALS + f""",
folded AS (SELECT repo_url, count(*) AS total_files,
    count(*) FILTER (label <> 'None') AS handled_files,
    arg_min(label, doc_id) FILTER (label <> 'None') AS first_label,
    bool_or(label = 'Basic') AS any_basic, bool_or(label = 'Advanced') AS any_advanced,
    string_agg(DISTINCT language, ';' ORDER BY language) AS languages,
    {_COUNTED}, 0 AS n_exponential_backoff FROM files GROUP BY repo_url),
repos AS (SELECT *, CASE WHEN first_label IS NULL THEN 'None'
    WHEN any_basic AND any_advanced THEN 'Mixed' ELSE first_label END AS exception_type,
    CASE WHEN contains(languages, ';') THEN 'Multiple' ELSE languages END AS language
  FROM folded)"""
_NAMES = {flag: "backoff" if flag == "exponential_backoff" else flag for flag in FLAGS}
_COUNTS = _RESULTS + f""",
counts AS (SELECT language, count(*) AS total_repos,
    {', '.join(f'count(*) FILTER (n_{flag} > 0) AS {name}' for flag, name in _NAMES.items())}
  FROM repos GROUP BY language)"""


@query("language_lookup", """WITH e(language, family) AS (VALUES ('en', 'germanic'),
  ('de', 'germanic'), ('fr', 'romance'))
SELECT d.doc_id, e.family, e.family IS NOT NULL AS matched
FROM documents d LEFT JOIN e ON lower(trim(d.lang)) = e.language""")
def language_lookup(spark, sf_dir):
    families = F.array(*[F.struct(F.lit(k).alias("language"), F.lit(v).alias("family"))
                         for k, v in (("en", "germanic"), ("de", "germanic"), ("fr", "romance"))])
    table = spark.range(1).select(F.inline(families))
    docs = tables.load(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("language"))
    return relational.lookup(docs, table, "language", scalars.language_join_key).select(
        "doc_id", "family", "matched")


_DIRS = ("src", "lib/vendor", "node_modules", "app/build-tools", "x/.git/y", "targets")
_NAMES_OF_FILES = (".py", ".java", ".js", ".ts", ".go", ".rb", ".cs", ".kt", ".swift", ".PY",
                   ".d.ts", ".tsx", "", ".py.txt")


@query("path_filter", f"""WITH p AS (SELECT doc_id, ([{', '.join(map(quoted, _DIRS))}])
    [doc_id % {len(_DIRS)} + 1] || '/' || lang || '/f' || doc_id
    || ([{', '.join(map(quoted, _NAMES_OF_FILES))}])[n_chars % {len(_NAMES_OF_FILES)} + 1] AS path
  FROM documents),
e AS (SELECT *, regexp_extract(path, '\\.[a-zA-Z]+$') AS ext FROM p),
l(ext, language) AS (VALUES
  {', '.join(f'({quoted(k)}, {quoted(v)})' for k, v in domain.EXTENSION_LANGUAGE.items())})
SELECT doc_id, path, ext, language FROM e JOIN l USING (ext)
WHERE NOT list_has_any(string_split(path, '/'), [{', '.join(map(quoted, domain.SKIP_DIRS))}])""")
def path_filter(spark, sf_dir):
    docs = tables.load(spark, sf_dir, "documents")
    folder = F.element_at(F.array(*map(F.lit, _DIRS)), (F.col("doc_id") % len(_DIRS) + 1).cast("int"))
    ending = F.element_at(F.array(*map(F.lit, _NAMES_OF_FILES)),
                          (F.col("n_chars") % len(_NAMES_OF_FILES) + 1).cast("int"))
    listing = docs.select("doc_id", F.concat(
        folder, F.lit("/"), "lang", F.lit("/f"), "doc_id", ending).alias("path"))
    return select_files(listing).select("doc_id", "path", "ext", "language")


@query("repo_key", r"""WITH t AS (SELECT page_id, string_split(
    regexp_replace(rtrim(url, '/'), '\.git$', ''), '/') AS p FROM pages)
SELECT page_id, p[-2] || '__' || p[-1] AS repo_key FROM t""")
def repo_key(spark, sf_dir):
    return tables.load(spark, sf_dir, "pages").select(
        "page_id", scalars.repo_key(F.col("url")).alias("repo_key"))


@query("url_host", r"""SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
  count(*) AS n_pages FROM pages GROUP BY 1""")
def url_host(spark, sf_dir):
    return tables.load(spark, sf_dir, "pages").groupBy(
        scalars.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("n_pages"))


@query("dedup_repos", r"""WITH t AS (SELECT string_split(
    regexp_replace(rtrim(url, '/'), '\.git$', ''), '/') AS p FROM pages)
SELECT DISTINCT p[-2] AS owner, p[-1] AS name FROM t""")
def dedup_repos(spark, sf_dir):
    parts = F.split(scalars.repo_key(F.col("url")), "__")
    named = tables.load(spark, sf_dir, "pages").select(
        F.element_at(parts, 1).alias("owner"), F.element_at(parts, -1).alias("name"))
    return relational.distinct_by(named, "owner", "name")


@query("decode_status", """SELECT doc_id, lang <> 'de' AS decode_ok,
  CASE WHEN lang <> 'de' THEN length(text) END AS n FROM documents""")
def decode_status(spark, sf_dir):
    tail = F.when(F.col("lang") == "de", F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    raw = tables.documents(spark, sf_dir).select(
        "doc_id", F.concat(F.encode("text", "UTF-8"), tail).alias("bytes"))
    body, ok = decoded(F.col("bytes"))
    return raw.select("doc_id", ok.alias("decode_ok"), F.length(body).cast("bigint").alias("n"))


@query("import_extract", """SELECT doc_id, len(w) AS n_lines, len(list_distinct(w)) AS n_names,
  array_to_string(list_sort(list_distinct(w)), ',') AS names
FROM (SELECT doc_id, regexp_extract_all(text, '(?m)^([A-Za-z]+)', 1) AS w FROM documents)""")
def import_extract(spark, sf_dir):
    words = text.find_all(F.col("text"), "(?dm)^([A-Za-z]+)")
    found = tables.documents(spark, sf_dir).select("doc_id", words.alias("w"))
    distinct = F.array_sort(F.array_distinct("w"))
    return found.select(
        "doc_id", F.size("w").cast("bigint").alias("n_lines"),
        F.size(distinct).cast("bigint").alias("n_names"),
        F.array_join(distinct, ",").alias("names"))


@query("normalised_text", r"""SELECT doc_id, md5(regexp_replace(
    replace(replace(replace(replace(text, chr(10), chr(13) || chr(10)), chr(13) || chr(10),
      chr(10)), chr(8217), ''''), chr(8220), '"'),
    '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]', '', 'g')) AS digest FROM documents""")
def normalised_text(spark, sf_dir):
    dressed = F.concat(F.lit("﻿"), F.replace("text", F.lit("\n"), F.lit("\r\n")))
    return tables.documents(spark, sf_dir).select(
        "doc_id", F.md5(text.normalise_source(dressed)).alias("digest"))


@query("compatibility_text", """SELECT doc_id, md5(regexp_replace(text || ' 한글 각 1 1⁄2 TEL',
    '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}]', '', 'g')) AS digest FROM documents""")
def compatibility_text(spark, sf_dir):
    """Texts with wide letters, ligatures, letters and marks apart and Hangul letter by letter."""
    apart = F.col("text")
    for whole, parts in (("é", "e\u0301"), ("è", "e\u0300"), ("ü", "u\u0308"), ("ç", "c\u0327"), ("fi", "\ufb01")):
        apart = F.replace(apart, F.lit(whole), F.lit(parts))
    wide = F.translate(apart, "bgk", "ｂｇｋ")
    tail = "\u3000\u1112\u1161\u11ab\uae00 \uac00\u11a8\u00a0\u2460\u2002\u00bd \u2121"
    return tables.documents(spark, sf_dir).select(
        "doc_id", F.md5(text.normalise_source(F.concat(wide, F.lit(tail)))).alias("digest"))


# ------------------------------------------------------------ surrogate rules
@query("signals_by_file", f"""WITH {_SIGNALS}
SELECT doc_id, basic, advanced, label, {', '.join(f'{f}' for f in _RULES)} FROM files""")
def signals_by_file(spark, sf_dir):
    return classified(spark, sf_dir).select(
        "doc_id", "basic", "advanced", "label",
        *(F.array_contains("flags", flag).alias(flag) for flag in _RULES))


@query("signals_by_repo", f"""WITH {_SIGNALS}
SELECT repo_url, flag, count(*) AS n_files FROM (
  {' UNION ALL '.join(f"SELECT repo_url, '{f}' AS flag FROM files WHERE {f}" for f in _RULES)}
) GROUP BY ALL""")
def signals_by_repo(spark, sf_dir):
    return flag_counts(classified(spark, sf_dir))


@query("file_labels", f"WITH {_SIGNALS} SELECT label, count(*) AS n FROM files GROUP BY label")
def file_labels(spark, sf_dir):
    return classified(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


@query("file_labels_by_language", f"""WITH {_SIGNALS} SELECT language,
  {', '.join(f"count(*) FILTER (label = '{c}') AS {c.lower()}" for c in domain.CATEGORIES)}
FROM files GROUP BY language""")
def file_labels_by_language(spark, sf_dir):
    return contingency.pivoted(classified(spark, sf_dir), "language", "label", domain.CATEGORIES)


@query("repo_results", f"""WITH {_RESULTS} SELECT repo_url, exception_type, languages,
  CASE exception_type {' '.join(f"WHEN {quoted(k)} THEN {quoted(v)}"
                                for k, v in domain.RECOMMENDATION.items())} END AS recommendation,
  total_files, handled_files, '100.00%' AS success,
  {', '.join(f'n_{f} > 0 AS has_{n}' for f, n in _NAMES.items())} FROM repos""")
def repo_results_query(spark, sf_dir):
    return results(spark, sf_dir).select(
        "repo_url", "exception_type", F.array_join("languages", ";").alias("languages"),
        "recommendation", "total_files", "handled_files",
        scalars.format_rate(F.col("parser_success_rate")).alias("success"),
        *(f"has_{n}" for n in _NAMES.values()))


@query("incremental_scan", f"""WITH {_SIGNALS},
folded AS (SELECT source AS repo_url, count(*) AS total_files,
    count(*) FILTER (label <> 'None') AS handled_files,
    arg_min(label, doc_id) FILTER (label <> 'None') AS first_label,
    bool_or(label = 'Basic') AS b, bool_or(label = 'Advanced') AS a,
    string_agg(DISTINCT language, ';' ORDER BY language) AS languages
  FROM files JOIN documents USING (doc_id) GROUP BY source)
SELECT repo_url, CASE WHEN first_label IS NULL THEN 'None' WHEN a AND b THEN 'Mixed'
  ELSE first_label END AS exception_type, languages, total_files, handled_files
FROM folded""")
def incremental_scan(spark, sf_dir):
    """The documents as a stream: scanned in micro-batches into a store of
    partial states, then read back merged."""
    drops = (
        spark.readStream.schema("doc_id bigint, text string, lang string, source string")
        .option("maxFilesPerTrigger", 1)
        .parquet(f"{sf_dir}/documents.parquet*")
    )
    files = tables.as_files(drops)
    folder = f"{checkpoint_dir(spark, local_folder(spark))}/incremental-scan-{uuid.uuid4().hex}"
    start_scan(files, f"{folder}/store", f"{folder}/progress", DOMAINS,
               languages=tables.DOCUMENT_LANGUAGES, rules=tables.SURROGATE_RULES, shapes=[],
               libraries=()).awaitTermination()
    return current_results(spark, f"{folder}/store", DOMAINS, merge=True).select(
        "repo_url", "exception_type", F.array_join("languages", ";").alias("languages"),
        "total_files", "handled_files")


_FILE_CELLS = _SIGNALS + """,
cells AS (SELECT language AS row_key, col_key, count(*) FILTER (label = col_key) AS n
  FROM files, (VALUES ('None'), ('Basic'), ('Mixed'), ('Advanced')) c(col_key) GROUP BY ALL),
pct AS (SELECT *, sum(n) OVER (PARTITION BY row_key) AS row_total,
  round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY row_key), 2) AS pct FROM cells)"""


def file_cells(spark, sf_dir):
    return contingency.contingency(
        classified(spark, sf_dir), "language", "label", domain.CATEGORIES)


@query("row_percentages", f"""WITH {_FILE_CELLS}
SELECT row_key, col_key, n, CAST(row_total AS BIGINT) AS row_total, pct FROM pct""")
def row_percentages(spark, sf_dir):
    return contingency.row_percentages(file_cells(spark, sf_dir))


_AM = "round(sum(pct) FILTER (col_key IN ('Advanced', 'Mixed')), 2)"


@query("advanced_mixed_share", f"""WITH {_FILE_CELLS}
SELECT row_key, {_AM} AS advanced_mixed_pct FROM pct GROUP BY row_key""")
def advanced_mixed_share(spark, sf_dir):
    return contingency.advanced_mixed_share(file_cells(spark, sf_dir))


@query("advanced_mixed_chart", f"""WITH {_FILE_CELLS},
s AS (SELECT row_key, {_AM} AS advanced_mixed_pct FROM pct GROUP BY row_key)
SELECT row_key, advanced_mixed_pct,
  round((SELECT avg(advanced_mixed_pct) FROM s), 6) AS mean_pct FROM s""")
def advanced_mixed_chart(spark, sf_dir):
    return reports.advanced_mixed_chart(file_cells(spark, sf_dir)).withColumn(
        "mean_pct", F.round("mean_pct", 6))


@query("percent_table", f"""WITH {_FILE_CELLS} SELECT row_key,
  CAST(any_value(row_total) AS BIGINT) AS row_total,
  {', '.join(f"max(pct) FILTER (col_key = '{c}') AS {c.lower()}_pct" for c in domain.CATEGORIES)},
  {_AM} AS advanced_mixed_pct FROM pct GROUP BY row_key""")
def percent_table(spark, sf_dir):
    return contingency.percent_table(file_cells(spark, sf_dir))


@query("language_category_chart", f"""WITH {_FILE_CELLS} SELECT row_key AS language,
  CASE row_key WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END AS ord,
  {', '.join(f"max(pct) FILTER (col_key = '{c}') AS {c.lower()}_pct" for c in domain.CATEGORIES)}
FROM pct GROUP BY row_key""")
def language_category_chart(spark, sf_dir):
    order = F.array(*[F.struct(F.lit(k).alias("language"), F.lit(i).alias("ord"))
                      for i, k in enumerate(("en", "de", "fr", "es"))])
    keys = spark.range(1).select(F.inline(order))
    return reports.language_category_chart(file_cells(spark, sf_dir), keys).select(
        "language", "ord", *(f"{c.lower()}_pct" for c in domain.CATEGORIES))


@query("language_report_lines", f"""WITH {_FILE_CELLS} SELECT row_key,
  printf('%-12s %7s', row_key, format('{{:,}}', CAST(any_value(row_total) AS BIGINT))) ||
  {' || '.join(f"printf(' %7.1f%%', round(100.0::DOUBLE * max(n) FILTER (col_key = '{c}') "
               f"/ any_value(row_total), 1))" for c in domain.CATEGORIES)} AS value
FROM pct GROUP BY row_key""")
def language_report_lines(spark, sf_dir):
    return reports.language_lines(file_cells(spark, sf_dir))


# ------------------------------------------------------------------- adoption
def counts(spark, sf_dir):
    found = results(spark, sf_dir)
    group = F.when(F.size("languages") > 1, domain.MULTIPLE).otherwise(
        F.element_at("languages", 1))
    return adoption.pattern_counts(found, group)


_TALL = f"(UNPIVOT counts ON {', '.join(PATTERNS)} INTO NAME pattern VALUE n_repos)"


@query("adoption_by_language", f"""WITH {_COUNTS}
SELECT language, total_repos, pattern, n_repos,
  round(100.0::DOUBLE * n_repos / total_repos, 1) AS pct FROM {_TALL}""")
def adoption_by_language(spark, sf_dir):
    return adoption.adoption_by_language(counts(spark, sf_dir)).drop("matched")


@query("adoption_given_totals", f"""WITH {_COUNTS},
totals AS (SELECT upper(lang) AS language, count(*) AS total FROM documents
  WHERE lang <> 'es' GROUP BY 1)
SELECT t.language, pattern, n_repos, total AS total_repos, total IS NOT NULL AS matched,
  round(100.0::DOUBLE * n_repos / total, 1) AS pct
FROM {_TALL} t LEFT JOIN totals ON lower(totals.language) = lower(t.language)""")
def adoption_given_totals(spark, sf_dir):
    totals = tables.load(spark, sf_dir, "documents").where("lang <> 'es'").groupBy(
        F.upper("lang").alias("language")).agg(F.count("*").alias("total_repos"))
    return adoption.adoption_by_language(counts(spark, sf_dir), totals)


_COMPARED = _COUNTS + f""",
sums AS (SELECT pattern,
    CAST(sum(n_repos) FILTER (language <> 'Multiple') AS BIGINT) AS single_n,
    CAST(sum(total_repos) FILTER (language <> 'Multiple') AS BIGINT) AS single_repos,
    CAST(sum(n_repos) FILTER (language = 'Multiple') AS BIGINT) AS multi_n,
    CAST(sum(total_repos) FILTER (language = 'Multiple') AS BIGINT) AS multi_repos
  FROM {_TALL} GROUP BY pattern),
compared AS (SELECT *, 100.0::DOUBLE * single_n / single_repos AS single_pct,
  100.0::DOUBLE * multi_n / multi_repos AS multi_pct FROM sums)"""


@query("adoption_single_vs_multi", f"""WITH {_COMPARED}
SELECT pattern, single_n, single_repos, multi_n, multi_repos,
  round(single_pct, 6) AS single_pct, round(multi_pct, 6) AS multi_pct,
  round(multi_pct - single_pct, 6) AS diff_points,
  CASE WHEN single_pct > 0 THEN round(multi_pct / single_pct, 6)
    ELSE 'infinity'::DOUBLE END AS ratio FROM compared""")
def adoption_single_vs_multi(spark, sf_dir):
    out = adoption.adoption_single_vs_multi(counts(spark, sf_dir)).drop("ord")
    finite = F.when(F.col("ratio") == float("inf"), F.col("ratio")).otherwise(
        F.round("ratio", 6))
    return out.withColumns({
        **{c: F.round(c, 6) for c in ("single_pct", "multi_pct", "diff_points")},
        "ratio": finite})


@query("adoption_mean", f"""WITH {_COMPARED},
m AS (SELECT avg(single_pct) AS s, avg(multi_pct) AS m FROM compared)
SELECT round(s, 6) AS single_mean_pct, round(m, 6) AS multi_mean_pct,
  round(m - s, 6) AS diff_points, round((m / s - 1) * 100, 6) AS lift_pct FROM m""")
def adoption_mean(spark, sf_dir):
    out = adoption.adoption_mean(adoption.adoption_single_vs_multi(counts(spark, sf_dir)))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query("adoption_chart", f"""WITH {_COMPARED}
SELECT pattern, round(single_pct, 1) AS single_pct, round(multi_pct, 1) AS multi_pct
FROM compared""")
def adoption_chart(spark, sf_dir):
    return reports.adoption_chart(
        adoption.adoption_single_vs_multi(counts(spark, sf_dir))).drop("ord")


@query("pattern_heatmap", f"""WITH {_COUNTS},
k(language, ord) AS (VALUES ('fr', 1), ('en', 2), ('Multiple', 3))
SELECT language, ord, {', '.join(f'round(100.0::DOUBLE * {p} / total_repos, 1) AS {p}'
                                 for p in PATTERNS)} FROM k JOIN counts USING (language)""")
def pattern_heatmap(spark, sf_dir):
    order = F.array(*[F.struct(F.lit(k).alias("language"), F.lit(i).alias("ord"))
                      for i, k in enumerate(("fr", "en", "Multiple"), 1)])
    shares = adoption.adoption_by_language(counts(spark, sf_dir))
    return adoption.pattern_heatmap(shares, spark.range(1).select(F.inline(order)))


_SUMS = ", ".join(f"CAST(sum({p}) AS BIGINT) AS {p}" for p in ("total_repos", *PATTERNS))


@query("subtotals", f"""WITH {_COUNTS}
SELECT language, false AS is_subtotal, total_repos, {', '.join(PATTERNS)} FROM counts
UNION ALL SELECT 'Single-Repo Total', true, {_SUMS} FROM counts WHERE language <> 'Multiple'""")
def subtotals(spark, sf_dir):
    return adoption.with_subtotal(counts(spark, sf_dir))


@query("drop_subtotal_rows", f"""WITH {_COUNTS}
SELECT language, total_repos, {', '.join(PATTERNS)} FROM counts""")
def drop_subtotal_rows(spark, sf_dir):
    kept = adoption.drop_subtotal_rows(adoption.with_subtotal(counts(spark, sf_dir)))
    return kept.drop("is_subtotal")


@query("patterns_per_repo_rank", f"""WITH {_COUNTS},
t AS (SELECT language, total_repos, {' + '.join(PATTERNS)} AS total_patterns FROM counts)
SELECT rank() OVER (ORDER BY total_patterns::DOUBLE / total_repos DESC) AS rank, language,
  total_repos, total_patterns,
  round(total_patterns::DOUBLE / total_repos, 6) AS patterns_per_repo FROM t""")
def patterns_per_repo_rank(spark, sf_dir):
    out = adoption.patterns_per_repo(counts(spark, sf_dir))
    return out.withColumns({"patterns_per_repo": F.round("patterns_per_repo", 6),
                            "rank": F.col("rank").cast("bigint")})


@query("flag_merge", f"""WITH {_SIGNALS} SELECT doc_id, array_to_string(list_sort(list_distinct(
  list_filter([{', '.join(f"CASE WHEN {f} THEN '{f}' END" for f in _RULES)},
    CASE WHEN language = 'en' THEN 'timeout' END, CASE WHEN n_chars > 2000 THEN 'retry' END],
    lambda x: x IS NOT NULL))), ';') AS flags FROM files""")
def flag_merge(spark, sf_dir):
    second = F.array_compact(F.array(
        F.when(F.col("language") == "en", "timeout"),
        F.when(F.length("content") > 2000, "retry")))
    # The second detector's flags travel as a column next to the files.
    files = tables.document_files(spark, sf_dir).withColumn("second", second)
    found = classify_files(files, languages=tables.DOCUMENT_LANGUAGES,
                           rules=tables.SURROGATE_RULES, shapes=[], libraries=())
    return found.select("doc_id", F.array_join(
        merge_flags(F.col("flags"), F.col("second")), ";").alias("flags"))
