"""Time the headline queries and print one JSON line.

BENCH_SF_DIR is the data folder, BENCH_CPUS the number of local threads, BENCH_REPEAT the timed
rounds over all queries; of each query the fastest run counts. A round that is not timed comes first,
since the first queries of a session would else pay for compiling what the later ones share.
"""

from __future__ import annotations

import json
import os
import time

from stockflow.queries import QUERIES
from stockflow.session import local_session

HEADLINE = [
    "daily_snapshot",
    "daily_rollup",
    "with_flows",
    "detect_transfers",
    "monthly_summary",
    "item_totals",
    "identity_conflicts",
    "find_spikes",
    "month_analysis",
    "enrich_daily",
    "item_series",
    "top_sellers",
    "export_top_fast",
    "export_top_restock",
    "canonical_names",
]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "stockflow-bench")
    spark.sparkContext.setLogLevel("ERROR")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    rounds = [[run(spark, name, folder) for name in names] for _ in range(repeat + 1)][1:]
    times = {name: min(found) for name, *found in zip(names, *rounds)}
    total = round(sum(times.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "total_query_time", "value": total, "unit": "sec", "queries": times, "sf": scale}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
