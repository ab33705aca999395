"""Signals that depend on nesting, on documents turned into nested code.

The SQL knows nothing of the library's scan: it lists a file's marks, takes depths from
them, finds each block's end as the mark where the depth falls back, follows headings
to their brace by recursion, and joins blocks with what lies between their ends.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.catalogs.signals import signal_rules
from faultlens.functions import scalars
from faultlens.functions.text import sql_text
from faultlens.operators.rollup import repo_results
from faultlens.operators.signals import BLOCK_PAIRS, classify_files
from faultlens.plans.workload import tables
from faultlens.plans.workload.registry import query
from faultlens.plans.workload.snippets import BROKEN_PYTHON, NESTED
from faultlens.plans.workload.source_sql import quoted

PIECES = 6

# Marks of each language, with the kind that a mark stands for (plain values).
_BRACES = (("open", r"\{"), ("close", r"\}"))
_C_LIKE = (("loop", r"\b(?:for|foreach|while|do)\b"), ("try", r"\btry\b"), ("catch", r"\bcatch\b"))
_MARKS = {
    "java": (*_BRACES, *_C_LIKE, ("status", r"(?i:status_?code)"), ("wait", r"\bsleep\("), ("again", r"\bcontinue\b")),
    "javascript": (*_BRACES, *_C_LIKE, ("wait", r"\b(?:sleep|setTimeout)\("), ("again", r"\bcontinue\b")),
    "go": (*_BRACES, ("loop", r"\bfor\b"), ("catch", r"\bif [^{}\n]*\berr != nil\b"), ("literal", r"\bfunc\("),
           ("recover", r"\brecover\("), ("wait", r"\btime\.Sleep\("), ("again", r"\bcontinue\b")),
    "csharp": (*_BRACES, *_C_LIKE, ("retry_method", r"(?:Task|void) \w*(?i:retry|retries)\w*\([^)]*\)"),
               ("wait", r"\.(?:Delay|Sleep)\("), ("again", r"\bcontinue\b")),
    "ruby": (("loop", r"\bwhile\b|\b(?:times|loop) do\b"), ("try", r"\bbegin\b"), ("open", r"\b(?:def|if)\b"),
             ("close", r"\bend\b"), ("catch", r"\brescue\b"), ("after", r"\bensure\b"),
             ("wait", r"\bsleep\b"), ("again", r"\b(?:retry|next)\b")),
}
_MARKS["typescript"] = _MARKS["javascript"]
_RETRIES = "'caught>wait' IN p OR 'caught>again' IN p"
_FLAGS = {
    "java": (("retry", _RETRIES), ("status_check", "'catch>status' IN p")),
    "javascript": (("retry", _RETRIES),),
    "typescript": (("retry", _RETRIES),),
    "go": (("defer_recover", "'literal>recover' IN p"), ("exponential_backoff", "'caught>wait' IN p"),
           ("retry", _RETRIES)),
    "ruby": (("exponential_backoff", "'catch>wait' IN p AND 'catch>again' IN p"), ("retry", _RETRIES)),
    "csharp": (("retry", f"'retry_method>loop' IN p OR {_RETRIES}"),),
}


def _sql(language: str) -> str:
    mark = tables.COMMENT[language]
    pieces = "[" + ", ".join(map(quoted, NESTED[language])) + "]"
    masked = f"regexp_replace(regexp_replace(raw, '{mark}[^\\n]*', ' ', 'g'), '\"[^\"\\n]*\"', ' ', 'g')"
    pattern = quoted("|".join(p for _, p in _MARKS[language]))
    kinds = " ".join(f"WHEN regexp_full_match(mark, {quoted(p)}) THEN '{k}'" for k, p in _MARKS[language])
    ruby = language == "ruby"
    # Ruby's headings open their block themselves; elsewhere a brace does, after its headings.
    opening = "kind IN ('open', 'loop', 'try')" if ruby else "kind = 'open'"
    heads = """SELECT doc_id, i, i AS spot, kind FROM opened WHERE kind <> 'open'""" if ruby else """
  SELECT o.doc_id, o.i, m.i AS spot, m.kind FROM opened o JOIN marks m ON m.doc_id = o.doc_id AND m.i = o.i - 1
  WHERE m.kind IN ('loop', 'try', 'catch', 'literal', 'retry_method')
  UNION ALL
  SELECT h.doc_id, h.i, m.i, m.kind FROM heads h JOIN marks m ON m.doc_id = h.doc_id AND m.i = h.spot - 1
  WHERE m.kind IN ('loop', 'try', 'catch', 'literal', 'retry_method')"""
    # A rescue lasts to the end, or the ensure, of the block it stands in.
    rescues = """UNION ALL
  SELECT r.doc_id, r.i, 'catch', (SELECT min(e.i) FROM marks e WHERE e.doc_id = r.doc_id AND e.i > r.i
    AND (e.kind = 'after' AND e.depth = r.depth OR e.kind = 'close' AND e.depth = r.depth - 1))
  FROM marks r WHERE r.kind = 'catch'""" if ruby else ""
    flags = ", ".join(f"CASE WHEN {test} THEN '{flag}' END" for flag, test in _FLAGS[language])
    return f"""WITH RECURSIVE
src AS (SELECT doc_id, '{mark} ' || replace(text, chr(10), chr(10) || '{mark}') || chr(10)
    || ({pieces})[(doc_id // 9) % {PIECES} + 1] AS raw FROM documents),
listed AS (SELECT doc_id, regexp_extract_all({masked}, {pattern}) AS found FROM src),
split AS (SELECT doc_id, unnest(found) AS mark, generate_subscripts(found, 1) AS i FROM listed),
named AS (SELECT doc_id, i, CASE {kinds} END AS kind FROM split),
marks AS (SELECT *, sum(CASE WHEN {opening} THEN 1 WHEN kind = 'close' THEN -1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY i) AS depth FROM named),
opened AS (SELECT o.doc_id, o.i, o.kind, (SELECT min(c.i) FROM marks c WHERE c.doc_id = o.doc_id
    AND c.i > o.i AND c.kind = 'close' AND c.depth = o.depth - 1) AS last
  FROM marks o WHERE {opening}),
heads AS ({heads}),
blocks AS (SELECT h.doc_id, h.spot AS i, h.kind, o.last FROM heads h JOIN opened o USING (doc_id, i) {rescues}),
caught AS (SELECT c.doc_id, c.i, 'caught' AS kind, c.last FROM blocks c WHERE c.kind = 'catch' AND EXISTS (
    SELECT 1 FROM blocks l WHERE l.doc_id = c.doc_id AND l.kind = 'loop' AND l.i < c.i AND c.i < l.last)),
pairs AS (SELECT b.doc_id, list(DISTINCT b.kind || '>' || m.kind) AS p
  FROM (FROM blocks UNION ALL FROM caught) b JOIN marks m ON m.doc_id = b.doc_id AND b.i < m.i AND m.i < b.last
  GROUP BY b.doc_id)
SELECT doc_id, coalesce(array_to_string(list_filter([{flags}], lambda f: f IS NOT NULL), ';'), '') AS flags
FROM src LEFT JOIN (SELECT doc_id, p FROM pairs) USING (doc_id)"""


def nested_files(spark, sf_dir: str, language: str):
    mark = tables.COMMENT[language]
    pieces = F.expr("array(" + ", ".join(map(sql_text, NESTED[language])) + ")")
    body = F.element_at(pieces, (F.floor(F.col("doc_id") / 9) % PIECES + 1).cast("int"))
    remark = F.concat(F.lit(mark + " "), F.replace("text", F.lit("\n"), F.lit("\n" + mark)))
    return tables.documents(spark, sf_dir).select(
        "doc_id", F.lit(language).alias("language"), F.concat(remark, F.lit("\n"), body).alias("content"))


def _register(language: str) -> None:
    @query(f"nested_signals_{language}", _sql(language))
    def nested_signals(spark, sf_dir):
        rules = [r for r in signal_rules(languages=(language,)) if r.target == BLOCK_PAIRS]
        found = classify_files(nested_files(spark, sf_dir, language), languages=(language,), rules=rules,
                               libraries=())
        return found.select("doc_id", F.array_join(F.array_sort("flags"), ";").alias("flags"))


for _language in NESTED:
    _register(_language)


def broken_files(spark, sf_dir: str):
    """Documents as Python files, some of which no parser accepts."""
    pieces = F.expr("array(" + ", ".join(map(sql_text, BROKEN_PYTHON)) + ")")
    body = F.element_at(pieces, (F.floor(F.col("n_chars") / 3) % len(BROKEN_PYTHON) + 1).cast("int"))
    remark = F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n#")))
    return tables.documents(spark, sf_dir).select(
        "doc_id", F.col("source").alias("repo_url"), F.format_string("%012d.py", "doc_id").alias("path"),
        F.lit("python").alias("language"), F.concat(remark, F.lit("\n"), body).alias("content"))


# Which pieces are broken is written out here: the even ones.
@query("broken_python_rates", f"""WITH f AS (SELECT source AS repo_url,
  (n_chars // 3) % {len(BROKEN_PYTHON)} % 2 = 0 AS broken, (n_chars // 3) % {len(BROKEN_PYTHON)} = 3 AS tries
  FROM documents)
SELECT repo_url, count(*) AS total_files, count(*) FILTER (broken) AS failed_files,
  round(count(*) FILTER (NOT broken) / count(*)::DOUBLE, 6) AS rate,
  printf('%.2f%%', 100.0::DOUBLE * count(*) FILTER (NOT broken) / count(*)) AS success,
  CASE WHEN bool_and(broken) THEN 'all_failed' ELSE 'ok' END AS status,
  bool_or(tries) AS has_try_catch, false AS has_retry FROM f GROUP BY repo_url""")
def broken_python_rates(spark, sf_dir):
    """Success rates of repositories with broken files; nothing in a broken file counts."""
    found = repo_results(classify_files(broken_files(spark, sf_dir), languages=("python",)))
    rate = F.col("parser_success_rate")
    return found.select(
        "repo_url", "total_files", "failed_files", F.round(rate, 6).alias("rate"),
        scalars.format_rate(rate).alias("success"), "status", "has_try_catch", "has_retry")
