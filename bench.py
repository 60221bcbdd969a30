"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is built and written to the no-op sink, so every output row and
column is computed and nothing is collected.  One warm-up query pays for the
start of the JVM; every measured time includes planning.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from talentgrid.plans import load_all  # noqa: E402
from talentgrid.session import get_session  # noqa: E402

HEADLINE = [
    "funnel_total", "funnel_by_position", "funnel_rates", "interview_status", "interview_list",
    "interview_export", "resume_search", "resume_page", "resume_export", "report_rows",
    "with_position", "invited_flag", "dependants", "propagate_match", "partial_update",
    "latest_version", "changed_since", "experience_top2", "best_duplicate", "text_stats",
    "clean_document_text", "line_repair", "best_extraction", "education_level", "emails",
    "phones", "extract_documents", "daily_funnel",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    queries = load_all().QUERIES
    spark = get_session("bench", cores=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries["interview_status"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        t = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - t, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
