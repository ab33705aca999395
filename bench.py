"""Wall time of the headline queries. Prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "corpus_scan", "corpus_library_catalog", "corpus_adoption",
    "signals_python", "signals_java", "signals_javascript", "signals_typescript", "signals_go",
    "signals_ruby", "signals_csharp", "signals_kotlin", "signals_swift",
    "libraries_python", "libraries_java", "libraries_javascript", "libraries_go",
    "signals_by_file", "repo_results", "adoption_single_vs_multi", "subtotals",
    "library_prefix", "library_contains", "library_catalog", "library_top3_languages",
    "repo_fold", "category_distribution", "contingency", "chi_square", "chi_contrib_top10",
    "chi_square_lineitem", "latest_wins", "resume_anti_join", "batch_counts", "json_ingest",
    "path_filter", "normalised_text",
)


def main() -> None:
    from faultlens.plans.workload import QUERIES
    from faultlens.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session("faultlens-bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's and the readers' one-time work before the clock.
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()

    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total wall time of headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(os.path.normpath(sf_dir)),
        "cpus": cores,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
