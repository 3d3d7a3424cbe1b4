"""Wall time of the headline queries: one JSON line.

BENCH_SF_DIR names the tables and BENCH_CPUS the local cores. Each query runs BENCH_RUNS times into
the no-op sink after one warm-up pass on the same session; the least time counts.
"""

from __future__ import annotations

import json
import os
import time

from rimlight.queries import QUERIES
from rimlight.session import build_session

HEADLINE = [
    "streak_labels",
    "zone_vs_league",
    "zone_table_league",
    "zone_table_self",
    "zone_tables_league",
    "zone_tables_self",
    "hex_cells",
    "hex_chart",
    "coverage_table",
    "percentile_breaks",
    "percentile_bands",
    "release_frame",
    "nearest_opponent",
    "quality_gate",
    "flatten_nested",
    "ingest_games",
    "extract_links",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").count().collect()

    times: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(min(taken), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
