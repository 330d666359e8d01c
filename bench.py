"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the data
and the local cores. Every query is built and run in full; nothing is cached between.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import checks  # noqa: E402
from scarpline.session import local_session  # noqa: E402

HEADLINE = [
    "catalog_scan", "event_dedup", "inventory_quality", "catalog_profile", "point_in_aoi",
    "horn_gradients", "slope", "raster_sample", "landcover_histogram",
    "aoi_mean_precip", "antecedent_features", "event_rainfall_join", "probe_window_asof", "source_ladder",
    "complete_accumulation", "rainfall_trigger", "risk_fusion", "current_and_forecast_risk",
    "buffered_negatives", "exposure_join", "binary_metrics", "roc_auc", "average_precision",
    "spatial_holdout", "grid_summary", "state_sweep", "fused_grid_overview", "training_matrix", "stream_accum", "stream_run_upgrade", "point_score", "grid_score",
    "raster_sample_many", "scenario_compare", "budgeted_negatives", "exposure_join_adaptive",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    # The first action pays for starting the engine, not for a query.
    spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("count(*)").collect()
    seconds, failed = {}, {}
    for key in [k for k in HEADLINE if k in checks.QUERIES]:
        start = time.perf_counter()
        try:
            checks.QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[key] = round(time.perf_counter() - start, 3)
        except Exception as error:
            failed[key] = f"{type(error).__name__}: {str(error)[:200]}"
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    line = {
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(sf.group(1)) if sf else None,
    }
    if failed:
        line["failed"] = failed
    print(json.dumps(line))


if __name__ == "__main__":
    main()
