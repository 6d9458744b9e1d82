"""Time the headline queries and print one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS (timed runs per query after one warm-up) set it up.
Every run computes all rows and columns and throws them away.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagemill.plans.queries import all_queries
from pagemill.session import build_session

HEADLINES = (
    "normalized_urls", "fetches", "page_titles", "html_tokens", "element_spans", "links_scoped", "page_links",
    "main_content", "md_blocks", "clean_lines", "page_documents", "robots_verdicts",
    "crawl_site", "crawl_progress", "crawl_stats", "combined_corpus",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    seconds: dict[str, float] = {}
    for name in HEADLINES:
        taken = []
        for _ in range(runs + 1):
            begun = time.perf_counter()
            all_queries()[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - begun)
        seconds[name] = round(statistics.median(taken[1:]), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total of median times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
