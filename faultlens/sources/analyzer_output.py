"""Results of external analyzers: one output text per file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.functions import scalars

# Fields an analyzer may report.
SCHEMA = (
    "hasBasicHandling boolean, hasAdvancedHandling boolean, patterns map<string,boolean>, "
    "resilienceLibraries array<string>, resilience_libraries array<string>, "
    "parse_error string, parseError string, error string"
)


def ingest(outputs: DataFrame, raw: str = "raw", mode: str = "fixed") -> DataFrame:
    """A JSON object, else the legacy pair ``true,false``, else a failure.

    A failure is a status of its own: an analyzer that ran and found nothing
    has empty flags and ``parse_status = 'ok'``. In parity mode any two parts
    make a pair, and a pair, which carries no flags, counts as a failure.
    """
    text = F.trim(F.col(raw))
    is_json = F.coalesce(
        text.startswith("{") & F.try_parse_json(F.col(raw)).isNotNull(), F.lit(False))
    pair = F.split(F.lower(text), ",")
    part = lambda i: F.trim(F.try_element_at(pair, F.lit(i)))
    known = F.lit(True) if mode == "parity" else (
        part(1).isin("true", "false") & part(2).isin("true", "false"))
    is_pair = F.coalesce(~is_json & (F.size(pair) == 2) & known, F.lit(False))
    no_names = F.array().cast("array<string>")
    out = outputs.withColumns({
        "_report": F.when(is_json, F.from_json(F.col(raw), SCHEMA)),
        "status": F.when(is_json, "json").when(is_pair, "legacy").otherwise("failed"),
        "_pair_basic": is_pair & (part(1) == "true"),
        "_pair_advanced": is_pair & (part(2) == "true"),
    })
    true_keys = F.map_keys(F.map_filter(F.col("_report.patterns"), lambda _, v: v))
    out = out.withColumns({
        "basic": F.coalesce("_report.hasBasicHandling", "_pair_basic"),
        "advanced": F.coalesce("_report.hasAdvancedHandling", "_pair_advanced"),
        "flags": F.array_sort(F.coalesce(true_keys, no_names)),
        "resilience_libraries": F.array_sort(F.array_union(
            F.coalesce("_report.resilienceLibraries", no_names),
            F.coalesce("_report.resilience_libraries", no_names))),
        "parse_error": F.coalesce("_report.parse_error", "_report.parseError", "_report.error"),
    })
    failures = ("failed", "legacy") if mode == "parity" else ("failed",)
    return out.withColumns({
        "label": scalars.file_label(F.col("basic"), F.col("advanced")),
        "parse_status": F.when(F.col("status").isin(*failures), "failed").otherwise("ok"),
    }).drop("_report", "_pair_basic", "_pair_advanced")
