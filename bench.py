"""Time the headline queries; one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Each query
is run to completion into the ``noop`` sink, so every row is produced and none
is brought to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

from metricloom.plans import workload
from metricloom.session import build_session

HEADLINE = [
    "dash_bucket_avg",
    "dash_bucket_avg_filtered",
    "dash_bucket_avg_raw",
    "dash_var_objects",
    "dash_var_types",
    "dash_var_stats",
    "metric_catalogue",
    "time_series",
    "histogram_rows",
    "attr_like",
    "tail_points",
    "series_samples",
    "series_latest",
    "series_exposition",
    "series_labels",
    "series_history",
    "series_instant",
    "series_range",
    "otlp_flatten",
    "jsonl_roundtrip",
    "table_roundtrip",
    "analysis_layout",
    "ingest_rate_windows",
    "query_api_json",
    "stream_ingest",
    "stream_latest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the executor threads before the first clock.
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        started = time.perf_counter()
        result = workload.QUERIES[name](spark, sf_dir)
        result.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
