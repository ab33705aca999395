"""Lookups, batches, stored results and analyzer output."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.catalogs import domain
from faultlens.functions import scalars
from faultlens.operators import relational
from faultlens.operators.rollup import canonical_results
from faultlens.plans.workload import tables
from faultlens.plans.workload.registry import query
from faultlens.plans.workload.source_sql import quoted
from faultlens.sources.analyzer_output import ingest


@query("latest_wins", """SELECT user_id, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def latest_wins(spark, sf_dir):
    rows = tables.load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return relational.latest_wins(rows, "user_id", "event_id")


@query("resume_anti_join", """SELECT c_custkey, c_name FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def resume_anti_join(spark, sf_dir):
    done = tables.load(spark, sf_dir, "orders").where("o_orderstatus = 'P'").withColumnRenamed(
        "o_custkey", "c_custkey")
    return relational.not_yet_done(
        tables.load(spark, sf_dir, "customer"), done, "c_custkey").select("c_custkey", "c_name")


@query("batch_counts", """WITH b AS (SELECT o_orderstatus,
  (row_number() OVER (ORDER BY o_orderkey) - 1) // 50 AS batch_id FROM orders)
SELECT batch_id, count(*) AS n_rows, count(*) FILTER (o_orderstatus <> 'F') AS n_ok,
  count(*) FILTER (o_orderstatus = 'F') AS n_failed FROM b GROUP BY batch_id""")
def batch_counts(spark, sf_dir):
    orders = tables.load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return relational.batch_counts(
        relational.numbered_batches(orders, "o_orderkey", 50), F.col("o_orderstatus") != "F")


@query("star_buckets", """WITH s AS (SELECT (p_size * p_size) // 10 AS stars FROM part)
SELECT CASE WHEN stars > 200 THEN '>200' WHEN stars >= 51 THEN '51-200'
  WHEN stars >= 11 THEN '11-50' WHEN stars >= 2 THEN '2-10' WHEN stars = 1 THEN '1'
  ELSE '0' END AS bucket, count(*) AS n FROM s GROUP BY 1""")
def star_buckets(spark, sf_dir):
    stars = F.floor(F.col("p_size") * F.col("p_size") / 10)
    return tables.load(spark, sf_dir, "part").groupBy(
        scalars.star_bucket(stars).alias("bucket")).agg(F.count("*").alias("n"))


_ERRORS = {
    "error": "remote: Repository Not Found ",
    "purchase": "The requested URL returned error: 403 ",
    "signup": "connection reset ",
    "click": "",
}


@query("error_text_class", f"""WITH t AS (SELECT event_id, CASE event_type
  {' '.join(f"WHEN '{k}' THEN {quoted(v)} || props" if v else f"WHEN '{k}' THEN ''"
            for k, v in _ERRORS.items())} END AS message FROM events)
SELECT event_id, coalesce(regexp_matches(lower(message),
  '{'|'.join(domain.PERMANENT_FETCH_ERRORS)}'), false) AS permanent FROM t""")
def error_text_class(spark, sf_dir):
    message = F
    for kind, text in _ERRORS.items():
        body = F.concat(F.lit(text), "props") if text else F.lit("")
        message = message.when(F.col("event_type") == kind, body)
    return tables.load(spark, sf_dir, "events").select(
        "event_id", scalars.is_permanent_fetch_error(message).alias("permanent"))


_REPORT = """'{"hasBasicHandling": true, "hasAdvancedHandling": ' || CASE WHEN value > 20
  THEN 'true' ELSE 'false' END || ', "patterns": {"try_catch": true, "retry": ' ||
  CASE WHEN value > 20 THEN 'true' ELSE 'false' END || '}, "resilience_libraries": ["lib' ||
  user_id || '"]}'"""


@query("json_ingest", f"""SELECT event_id,
  CASE WHEN event_type IN ('purchase', 'view') THEN 'json' WHEN event_type = 'error'
    THEN 'failed' ELSE 'legacy' END AS status,
  event_type IN ('purchase', 'click') AS basic,
  event_type = 'signup' OR (event_type = 'purchase' AND value > 20) AS advanced,
  CASE WHEN event_type <> 'purchase' THEN '' WHEN value > 20 THEN 'retry;try_catch'
    ELSE 'try_catch' END AS flags,
  CASE WHEN event_type = 'purchase' THEN 'lib' || user_id ELSE '' END AS libraries,
  json_extract_string(props, '$.k') AS k FROM events""")
def json_ingest(spark, sf_dir):
    kind = F.col("event_type")
    raw = (
        F.when(kind == "purchase", F.expr(_REPORT))
        .when(kind == "view", F.col("props")).when(kind == "click", " true,False ")
        .when(kind == "signup", "false,true").otherwise(F.concat(F.lit("boom "), "props"))
    )
    events = tables.load(spark, sf_dir, "events").withColumn("raw", raw)
    return ingest(events).select(
        "event_id", "status", "basic", "advanced", F.array_join("flags", ";").alias("flags"),
        F.array_join("resilience_libraries", ";").alias("libraries"),
        F.get_json_object("props", "$.k").alias("k"))


_BRANDS = """b AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand),
big AS (SELECT DISTINCT ' ' || upper(p_brand) || ' ' AS p_brand FROM part WHERE p_size = 50)"""


def _brands(spark, sf_dir):
    part = tables.load(spark, sf_dir, "part")
    counts = part.groupBy("p_brand").agg(F.count("*").alias("n"))
    big = part.where("p_size = 50").groupBy(
        F.concat(F.lit(" "), F.upper("p_brand"), F.lit(" ")).alias("p_brand")
    ).agg(F.count("*").alias("n_big"))
    return counts, big


@query("lookup_left_join", f"""WITH {_BRANDS},
m AS (SELECT upper(p_brand) AS k, count(*) AS n_big FROM part WHERE p_size = 50 GROUP BY 1)
SELECT p_brand, n, coalesce(n_big, -1) AS n_big, n_big IS NOT NULL AS matched
FROM b LEFT JOIN m ON k = upper(p_brand)""")
def lookup_left_join(spark, sf_dir):
    counts, big = _brands(spark, sf_dir)
    out = relational.lookup(counts, big, "p_brand", scalars.language_join_key)
    return out.select("p_brand", "n", F.coalesce("n_big", F.lit(-1)).alias("n_big"), "matched")


@query("lookup_unmatched_keys", f"""WITH {_BRANDS} SELECT p_brand FROM b
WHERE lower(p_brand) NOT IN (SELECT lower(trim(p_brand)) FROM big)""")
def lookup_unmatched_keys(spark, sf_dir):
    counts, big = _brands(spark, sf_dir)
    return relational.unmatched_keys(counts, big, "p_brand", scalars.language_join_key)


@query("reorder_keys", """WITH b AS (SELECT p_brand, count(*) AS n,
  min(p_partkey) AS ord FROM part GROUP BY p_brand) SELECT p_brand, ord, n FROM b""")
def reorder_keys(spark, sf_dir):
    part = tables.load(spark, sf_dir, "part")
    keys = part.groupBy("p_brand").agg(F.min("p_partkey").alias("ord"))
    counts = part.groupBy("p_brand").agg(F.count("*").alias("n"))
    return relational.reorder(counts, keys, "p_brand").select("p_brand", "ord", "n")


@query("drop_failed", """SELECT user_id AS repo_url, event_id, CASE event_type
  WHEN 'view' THEN 'None' WHEN 'purchase' THEN 'Advanced' ELSE 'Basic' END AS exception_type
FROM events WHERE event_type <> 'error'""")
def drop_failed(spark, sf_dir):
    rows = tables.event_labels(spark, sf_dir).select(
        F.col("user_id").alias("repo_url"), "event_id",
        F.when(F.col("event_type") != "error", F.col("label")).alias("exception_type"))
    return canonical_results(rows)


@query("numeric_coerce", """WITH t AS (SELECT event_id, CASE WHEN event_type = 'error'
    THEN props ELSE ' ' || json_extract_string(props, '$.k') || ' ' END AS cell FROM events)
SELECT event_id, TRY_CAST(trim(cell) AS BIGINT) AS n FROM t""")
def numeric_coerce(spark, sf_dir):
    cell = F.when(F.col("event_type") == "error", F.col("props")).otherwise(
        F.concat(F.lit(" "), F.get_json_object("props", "$.k"), F.lit(" ")))
    return tables.load(spark, sf_dir, "events").select(
        "event_id", relational.numeric(cell, "bigint").alias("n"))
