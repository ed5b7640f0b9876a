"""Times the headline queries and prints one JSON line.

Each query is planned anew and written to the no-op sink, so that every row and column
is computed and nothing is collected. One untimed run comes first; the figure is the
median of the timed ones.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from pagemark.catalog.queries import QUERIES

HEADLINE = (
    "html_tokens", "visible_text", "landmark_articles", "density_articles", "article_scores",
    "html_to_markdown", "article_markdown", "links_normalized", "tracking_stripped",
    "semantic_overlap", "compare_and_decide", "code_languages",
    "blocker_flags", "ingest",
)


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("pagemark-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("pagemark.partitions", cpus)  # the tables are single small files
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        times = []
        for _ in range(runs + 1):
            begin = time.perf_counter()
            QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - begin)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, total of medians", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(directory.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
