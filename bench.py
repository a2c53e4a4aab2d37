"""Times the headline queries and prints one JSON line.

``files`` and ``entities`` are the ingest of the derived corpus and the whole
extraction; the other queries start from the tables these leave.
"""

from __future__ import annotations

import json
import os
import time

from workload import catalogue
from workload.local import local_session
from workload.registry import corpus

HEADLINE = [
    "lines", "statements", "split_args", "fields", "methods", "views", "access_rights",
    "manifests", "assign_modules", "issues", "issues_english", "filter_issues", "relationships",
    "transitions", "er_diagram", "class_diagrams", "edge_severity", "menu_paths", "file_tree",
    "stats", "module_health", "model_inventory", "fixes_per_file", "noted_fixes", "diff_lines",
    "upsert_users", "newest_audit", "push_events",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS"))
    spark.range(1).count()
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)

    tables = corpus(spark, sf_dir)
    timed("files", lambda: tables.files)
    timed("entities", lambda: tables.entities)
    for name in HEADLINE:
        timed(
            name,
            lambda: catalogue.QUERIES[name](spark, sf_dir)
            .write.format("noop").mode("overwrite").save(),
        )
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
