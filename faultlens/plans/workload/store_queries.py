"""Round trips through files and stores, and what a corpus has besides good files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from faultlens.functions import scalars
from faultlens.operators import contingency
from faultlens.operators.distribution import category_counts
from faultlens.operators.rollup import Domains, partial_rollup, repo_results, with_empty_repositories
from faultlens.operators.signals import classify_files
from faultlens.plans.workload import tables
from faultlens.plans.workload.registry import query
from faultlens.session import checkpoint_dir, local_folder
from faultlens.sources import archives, clustered, repositories
from faultlens.sources.tables import append_results, export_csv, load_results, load_table
from faultlens.streaming import incremental, keyed


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark, local_folder(spark))}/{name}-{uuid.uuid4().hex}"


@query("repository_list", """SELECT CAST(c_custkey AS VARCHAR) AS id,
  'https://example.com/' || c_nationkey || '/' || c_name AS repo_url,
  CASE WHEN c_custkey % 5 > 0 THEN CAST(c_custkey * 3 AS INTEGER) END AS stars,
  c_nationkey || '__' || c_name AS repo_key FROM customer""")
def repository_list(spark, sf_dir):
    """Customers written as a repository list and read back, some without a number of stars."""
    customers = tables.load(spark, sf_dir, "customer")
    path = _folder(spark, "repositories")
    stars = F.when(F.col("c_custkey") % 5 > 0, (F.col("c_custkey") * 3).cast("string")).otherwise("n/a")
    url = F.concat_ws("/", F.lit("https://example.com"), "c_nationkey", "c_name")
    given = {"id": F.col("c_custkey").cast("string"), "repo_url": url, "stars": stars}
    customers.select(*(
        given.get(name, F.lit("x")).alias(name) for name in repositories.SCHEMA.fieldNames()
    )).write.option("header", True).csv(path)
    return repositories.distinct_repositories(
        repositories.read_repositories(spark, path)).select("id", "repo_url", "stars", "repo_key")


@query("stored_results", """WITH b AS (SELECT CAST(user_id AS VARCHAR) AS repo_url,
  event_id % 2 AS batch_id, count(*) AS n, max(event_id) AS last FROM events GROUP BY ALL)
SELECT repo_url, n, last, CAST(batch_id AS INTEGER) AS batch_id FROM b
QUALIFY row_number() OVER (PARTITION BY repo_url ORDER BY batch_id DESC) = 1""")
def stored_results(spark, sf_dir):
    """Two batches of results appended to a store, one of them again; the newest row of each."""
    events = tables.load(spark, sf_dir, "events")
    path = _folder(spark, "results")
    for batch in (0, 1, 0):
        append_results(events.where(F.col("event_id") % 2 == batch).groupBy(
            F.col("user_id").cast("string").alias("repo_url")).agg(
            F.count("*").alias("n"), F.max("event_id").alias("last")), path, batch)
    return load_results(spark, path).select("repo_url", "n", "last", F.col("batch_id").cast("int"))


_LABEL = """CASE event_type WHEN 'view' THEN 'None' WHEN 'click' THEN 'Basic'
  WHEN 'signup' THEN 'Basic' WHEN 'purchase' THEN 'Advanced' WHEN 'error' THEN 'Mixed' END"""


@query("count_table_csv", f"""WITH l AS (SELECT 'u' || (user_id % 40) AS row_key,
  {_LABEL} AS label FROM events)
SELECT row_key, col_key, count(*) FILTER (label = col_key) AS n
FROM l, (VALUES ('None'), ('Basic'), ('Mixed'), ('Advanced')) c(col_key) GROUP BY ALL""")
def count_table_csv(spark, sf_dir):
    """Counts as a wide CSV with padded and differing column names, read back as cells."""
    labels = tables.event_labels(spark, sf_dir).withColumn(
        "Language", F.concat(F.lit("u"), F.col("user_id") % 40))
    wide = contingency.pivoted(labels, "Language", "label", ("None", "Basic", "Mixed", "Advanced"))
    path = _folder(spark, "counts") + ".csv"
    wide.toDF("Language ", " Files None", "Basic ", " count mixed", "Adv").write.option(
        "header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    return contingency.cells_from_counts(load_table(spark, path))


@query("null_category", f"""WITH l AS (SELECT coalesce(
  CASE WHEN event_id % 3 > 0 THEN {_LABEL} END, 'None') AS label FROM events)
SELECT ord, category, count(*) FILTER (label = category) AS n
FROM l, (VALUES (0, 'None'), (1, 'Basic'), (2, 'Mixed'), (3, 'Advanced')) c(ord, category)
GROUP BY ALL""")
def null_category(spark, sf_dir):
    """Every third label is missing and counts as ``None``."""
    labels = tables.event_labels(spark, sf_dir).withColumn(
        "label", scalars.category_or_none(F.when(F.col("event_id") % 3 > 0, F.col("label"))))
    return category_counts(labels, "label")


_LISTS = Domains(("en", "de"), (), (), ("try_catch",))


def _partly_broken(spark, sf_dir):
    """Documents as files: every seventh does not decode, every eleventh is of a language
    that has no rules; only some names are listed."""
    files = tables.document_files(spark, sf_dir)
    files = files.withColumn("decode_ok", F.col("doc_id") % 7 != 0).withColumn(
        "language", F.when(F.col("doc_id") % 11 == 0, "klingon").otherwise(F.col("language")))
    return classify_files(files, languages=tables.DOCUMENT_LANGUAGES,
                          rules=tables.SURROGATE_RULES, shapes=[], libraries=())


@query("partly_broken_corpus", """WITH f AS (SELECT source AS repo_url, doc_id % 7 = 0 AS failed,
  CASE WHEN doc_id % 11 = 0 THEN 'klingon' ELSE lang END AS language, text FROM documents),
r AS (SELECT repo_url, count(*) AS total_files, count(*) FILTER (failed) AS failed_files,
  coalesce(string_agg(DISTINCT language, ';' ORDER BY language) FILTER (NOT failed), '') AS languages,
  concat_ws(';', CASE WHEN bool_or(x AND contains(text, '|')) THEN 'circuit_breaker' END,
    CASE WHEN bool_or(x AND regexp_matches(text, '[%#*$&]{3}')) THEN 'retry' END,
    CASE WHEN bool_or(x AND regexp_matches(text, '@[A-Za-z]')) THEN 'status_check' END,
    CASE WHEN bool_or(x AND contains(text, 'token = ')) THEN 'timeout' END) AS other_flags
  FROM (SELECT *, NOT failed AND language <> 'klingon' AS x FROM f) GROUP BY repo_url)
SELECT repo_url, total_files, failed_files, languages, other_flags,
  round((total_files - failed_files) / total_files::DOUBLE, 6) AS rate,
  CASE WHEN failed_files = total_files THEN 'all_failed' ELSE 'ok' END AS status FROM r
UNION ALL SELECT 'https://example.com/empty/' || n_name, 0, 0, '', '', 0.0, 'no_files' FROM nation""")
def partly_broken_corpus(spark, sf_dir):
    """Rates between 0 and 1, a language and flags outside the lists, empty repositories."""
    found = repo_results(_partly_broken(spark, sf_dir), domains=_LISTS)
    listed = tables.load(spark, sf_dir, "nation").select(
        F.concat(F.lit("https://example.com/empty/"), "n_name").alias("repo_url"))
    return with_empty_repositories(found, listed).select(
        "repo_url", "total_files", "failed_files", F.array_join("languages", ";").alias("languages"),
        F.array_join("other_flags", ";").alias("other_flags"),
        F.round("parser_success_rate", 6).alias("rate"), "status")


@query("keyed_results", """WITH c AS (SELECT source AS repo_url, count(*) AS n,
  count(*) FILTER (doc_id % 3 = 0) AS again FROM documents GROUP BY source)
SELECT repo_url, CASE WHEN again > 0 THEN again ELSE n END AS total_files FROM c""")
def keyed_results(spark, sf_dir):
    """A store that is written twice: a repository's later state replaces the earlier."""
    signals, store = _partly_broken(spark, sf_dir), _folder(spark, "states")
    for batch, part in ((0, signals), (1, signals.where("doc_id % 3 = 0"))):
        partial_rollup(part, domains=_LISTS).write.parquet(f"{store}/batch_id={batch}")
    return incremental.current_results(spark, store, _LISTS).select("repo_url", "total_files")


@query("chunk_report", """WITH c AS (SELECT b AS batch_id, source,
  bool_or(doc_id % 7 <> 0) AS ok FROM documents, (VALUES (0), (1)) x(b)
  WHERE doc_id % 2 = b GROUP BY ALL)
SELECT CAST(batch_id AS INTEGER) AS batch_id, count(*) AS n_rows,
  count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_failed FROM c GROUP BY batch_id""")
def chunk_report(spark, sf_dir):
    """Repositories with and without an analysed file, for each stored chunk."""
    signals, store = _partly_broken(spark, sf_dir), _folder(spark, "chunks")
    for batch in (0, 1):
        partial_rollup(signals.where(F.col("doc_id") % 2 == batch), domains=_LISTS).write.parquet(
            f"{store}/batch_id={batch}")
    return incremental.progress(spark, store).withColumn("batch_id", F.col("batch_id").cast("int"))


_RULES = {r.flags[0]: r.pattern for r in tables.SURROGATE_RULES}
_DELIVERED = "doc_id long, repo_url string, path string, language string, content string, version long"


@query("keyed_stream", f"""WITH s AS (SELECT source AS repo_url, lang AS language, doc_id,
    CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS text FROM documents),
g AS (SELECT *, {', '.join(f"regexp_matches(text, '{p}') AS {f}" for f, p in _RULES.items())} FROM s),
f AS (SELECT *, CASE WHEN (try_catch OR status_check) AND (timeout OR retry OR circuit_breaker) THEN 'Mixed'
  WHEN timeout OR retry OR circuit_breaker THEN 'Advanced' WHEN try_catch OR status_check THEN 'Basic'
  ELSE 'None' END AS label FROM g),
r AS (SELECT repo_url, count(*) AS total_files, count(*) FILTER (label <> 'None') AS handled_files,
  arg_min(label, doc_id) FILTER (label <> 'None') AS first_label, bool_or(label = 'Basic') AS b,
  bool_or(label = 'Advanced') AS a, string_agg(DISTINCT language, ';' ORDER BY language) AS languages,
  count(*) FILTER (retry) AS n_retry, count(*) FILTER (try_catch) AS n_try_catch FROM f GROUP BY repo_url)
SELECT repo_url, total_files, handled_files, languages, n_retry, n_try_catch,
  CASE WHEN first_label IS NULL THEN 'None' WHEN a AND b THEN 'Mixed' ELSE first_label END AS exception_type
FROM r""")
def keyed_stream(spark, sf_dir):
    """The documents as deliveries in three micro-batches: all of them, then a third in a newer
    version that is empty and a third in an older one, then some once more."""
    session, folder = keyed.stateful_session(spark), _folder(spark, "keyed-stream")
    docs = tables.document_files(spark, sf_dir).select(
        "doc_id", "repo_url", "path", "language", "content", F.lit(1).cast("long").alias("version"))
    third = F.col("doc_id") % 3
    changed = docs.where(third < 2).withColumns({
        "content": F.lit(""), "version": F.when(third == 0, 2).otherwise(0).cast("long")})
    for batch in (docs, changed, docs.where(F.col("doc_id") % 5 == 0)):
        batch.write.mode("append").parquet(f"{folder}/drops")
        stream = session.readStream.schema(_DELIVERED).parquet(f"{folder}/drops")
        keyed.start_keyed_scan(
            stream, f"{folder}/store", F.col("version"), f"{folder}/progress",
            languages=tables.DOCUMENT_LANGUAGES, rules=tables.SURROGATE_RULES, shapes=[], libraries=(),
        ).awaitTermination()
    count = lambda flag: F.coalesce(F.try_element_at("flags", F.lit(flag)), F.lit(0))
    return keyed.keyed_results(spark, f"{folder}/store").select(
        "repo_url", "total_files", "handled_files", F.array_join("languages", ";").alias("languages"),
        count("retry").alias("n_retry"), count("try_catch").alias("n_try_catch"), "exception_type")


@query("clustered_results", """WITH b AS (SELECT user_id, event_id % 4 AS batch, count(*) AS n,
  max(event_id) AS last, bool_or(event_type = 'error') AS failed FROM events GROUP BY ALL)
SELECT 'r' || user_id AS repo_url, n, last, failed FROM b
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY batch DESC) = 1""")
def clustered_results(spark, sf_dir):
    """Results in a store in hash buckets: a base, two batches that are merged into it, one more."""
    folder = _folder(spark, "clustered")

    def part(batch: int):
        return tables.load(spark, sf_dir, "events").where(F.col("event_id") % 4 == batch).groupBy(
            F.concat(F.lit("r"), "user_id").alias("repo_url")).agg(
            F.count("*").alias("n"), F.max("event_id").alias("last"),
            F.bool_or(F.col("event_type") == "error").alias("failed"))

    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    clustered.create_store(part(0), folder, "repo_url", buckets)
    for batch in (1, 2):
        clustered.append_batch(part(batch), folder, batch)
    clustered.merge_batches(spark, folder)
    clustered.append_batch(part(3), folder, 3)
    return clustered.load_clustered(spark, folder)


_FOLDERS = ("src", "lib/vendor", "app", "node_modules/x", "a/b/c", "build")
_ENDINGS = (".py", ".java", ".md", ".go", ".PY", ".swift", "")


@query("archived_tree", f"""WITH p AS (SELECT source AS repo_url, text,
  ([{', '.join(f"'{f}'" for f in _FOLDERS)}])[doc_id % {len(_FOLDERS)} + 1] || '/f' || doc_id
  || ([{', '.join(f"'{e}'" for e in _ENDINGS)}])[n_chars % {len(_ENDINGS)} + 1] AS path FROM documents)
SELECT repo_url, path, CASE regexp_extract(path, '\\.[a-z]+$') WHEN '.py' THEN 'python' WHEN '.java' THEN 'java'
  WHEN '.go' THEN 'go' ELSE 'swift' END AS language, md5(text) AS digest, strlen(text) AS size_bytes
FROM p WHERE regexp_matches(path, '\\.(py|java|go|swift)$')
  AND NOT regexp_matches(path, '(^|/)(vendor|node_modules|build)/')""")
def archived_tree(spark, sf_dir):
    """The documents as source trees, packed into archives and read back by ranges of them."""
    folder = _folder(spark, "archives")

    def one_of(values, number):
        return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))

    path = F.concat(one_of(_FOLDERS, F.col("doc_id")), F.lit("/f"), "doc_id", one_of(_ENDINGS, F.col("n_chars")))
    archives.write_archives(tables.documents(spark, sf_dir).select(
        F.col("source").alias("repo_url"), path.alias("path"), F.col("text").alias("content")), folder)
    return archives.read_archives(spark, folder, 1 << 20).select(
        "repo_url", "path", "language", F.md5("content").alias("digest"), "size_bytes")


_EXPORTED = ("Has Try-Catch", "Has Timeout", "Has Retry")


@query("exported_csv", f"""WITH g AS (SELECT source AS repo_url, lang, doc_id % 7 = 0 AS failed,
  {', '.join(f"regexp_matches(text, '{p}') AS {f}" for f, p in _RULES.items())} FROM documents),
r AS (SELECT repo_url, count(*) AS n, count(*) FILTER (failed) AS bad,
  string_agg(DISTINCT lang, '; ' ORDER BY lang) FILTER (NOT failed) AS languages,
  {', '.join(f"bool_or({f} AND NOT failed) AS {f}" for f in ("try_catch", "timeout", "retry"))}
  FROM g GROUP BY repo_url)
SELECT repo_url, languages AS "Languages", 'None detected' AS "HTTP Libraries",
  printf('%.2f%%', 100.0::DOUBLE * (n - bad) / n) AS "Parser Success Rate",
  CASE WHEN try_catch THEN 'True' ELSE 'False' END AS "Has Try-Catch",
  CASE WHEN timeout THEN 'True' ELSE 'False' END AS "Has Timeout",
  CASE WHEN retry THEN 'True' ELSE 'False' END AS "Has Retry" FROM r""")
def exported_csv(spark, sf_dir):
    """Repository rows of a corpus that is partly unreadable, exported as text and read back."""
    files = tables.document_files(spark, sf_dir).withColumn("decode_ok", F.col("doc_id") % 7 != 0)
    found = repo_results(classify_files(
        files, languages=tables.DOCUMENT_LANGUAGES, rules=tables.SURROGATE_RULES, shapes=[], libraries=("http",)))
    path = _folder(spark, "exported")
    export_csv(found, path)
    return load_table(spark, path + "/*.csv").select(
        "repo_url", "Languages", "HTTP Libraries", "Parser Success Rate", *_EXPORTED)


@query("redelivered_files", f"""WITH g AS (SELECT source AS repo_url,
  CASE WHEN doc_id % 4 = 1 THEN 'token = ' ELSE text END AS text FROM documents),
f AS (SELECT *, {', '.join(f"regexp_matches(text, '{p}') AS {f}" for f, p in _RULES.items())} FROM g)
SELECT repo_url, count(*) AS total_files, count(*) FILTER (timeout) AS n_timeout,
  count(*) FILTER (try_catch OR status_check OR timeout OR retry OR circuit_breaker) AS handled_files
FROM f GROUP BY repo_url""")
def redelivered_files(spark, sf_dir):
    """The documents streamed into a store of file states, a quarter of them again in a later
    batch with another text: only those are replaced, and compaction changes nothing."""
    folder = _folder(spark, "redelivered")
    docs = tables.documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    again = docs.where("doc_id % 4 = 1").withColumn("text", F.lit("token = "))
    for batch in (docs, again):
        batch.write.mode("append").parquet(f"{folder}/drops")
        stream = spark.readStream.schema(docs.schema).parquet(f"{folder}/drops")
        incremental.start_scan(
            tables.as_files(stream), f"{folder}/store", f"{folder}/progress", _LISTS,
            languages=tables.DOCUMENT_LANGUAGES, rules=tables.SURROGATE_RULES, shapes=[], libraries=(),
        ).awaitTermination()
    incremental.compact(spark, f"{folder}/store", f"{folder}/compacted")
    found = incremental.current_results(spark, f"{folder}/compacted", _LISTS)
    states = incremental.stored_partials(spark, f"{folder}/compacted")
    counts = states.groupBy("repo_url").agg(
        F.count_if(F.array_contains("unlisted", "flags:timeout")).alias("n_timeout"))
    return found.join(counts, "repo_url").select("repo_url", "total_files", "n_timeout", "handled_files")
