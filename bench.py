"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the folder of generated tables, BENCH_CPUS the number of local threads.
"""

from __future__ import annotations

import json
import os
import sys
import time

from leafwork.catalog.queries import run
from leafwork.session import build_session, drop_staged

HEADLINE = [
    "root_status", "cleanup_orphans", "ancestor_chain", "block_to_page", "tree_listing", "pull_queue",
    "queue_chunks", "queue_budget", "page_paths", "render_pages", "render_databases", "child_ids",
    "compact_merge", "index_lines", "reindex_latest", "document_diff", "attachment_links",
    "event_queue", "event_debounce", "sync_documents",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "leafwork-bench", f"local[{cpus}]", spark_sql_shuffle_partitions=cpus, spark_driver_memory="16g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderstatus").count().collect()
    chosen = sys.argv[1:] or HEADLINE
    times = {}
    for name in chosen:
        started = time.perf_counter()
        run(name, spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        drop_staged(spark)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
