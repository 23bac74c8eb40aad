"""Time the registered queries; prints one JSON line.

BENCH_SF_DIR chooses the tables, BENCH_CPUS the cores, BENCH_QUERIES (comma separated) a subset.
Each query runs twice, each time to its last row, into a sink that discards the rows; the second
run is reported, so that compiling and starting Python workers is not charged to any of them.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pagequarry.plans.queries import QUERIES
from pagequarry.session import build_session


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = os.environ.get("BENCH_QUERIES", "")
    chosen = names.split(",") if names else list(QUERIES)
    spark = build_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    spent = {}
    for name in chosen:
        first, spent[name] = run(name), run(name)
        print(f"{name}: {first} {spent[name]}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(spent.values()), 3),
                "unit": "sec",
                "queries": spent,
                "sf": os.path.basename(folder).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
