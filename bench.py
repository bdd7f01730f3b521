"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the input folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from panelspark.queries import QUERIES  # noqa: E402
from panelspark.session import local_session  # noqa: E402

HEADLINE = (
    "entity_persistence_metrics",
    "exact_date_lag",
    "rolling_features",
    "trend_features",
    "weekly_weather",
    "zonal_rainfall",
    "conflict_resolve",
    "interval_overlap_join",
    "daily_keep_last",
    "text_table_extract",
    "baseline_wide_coverage",
    "cohort_fingerprint",
    "threshold_binding",
    "expanding_folds",
    "config_metrics",
    "temporal_error",
    "block_bootstrap_model",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), app="panelspark-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
