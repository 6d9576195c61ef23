"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR: table folder (default /root/testdata/sf0.1). BENCH_CPUS: local cores (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from patchscope.plans import all_queries  # noqa: E402
from patchscope.session import local_session  # noqa: E402

HEADLINE = [
    "skill_table", "threshold_sweep", "rank_auc", "reliability_curve", "outcome_rows", "top_percentile",
    "split_balanced", "split_kfold", "evaluation_members", "fit_scaler", "standardise", "tabular_features",
    "storm_extremes", "feature_medians", "exceed_map", "composite_groups", "bootstrap_scores",
    "bootstrap_median_interval", "bootstrap_gather", "permutation_scores", "permutation_misses", "storm_counts", "mean_of_monthly_means",
    "interpolated_levels", "updraft_helicity", "cloud_top_temperature", "storm_objects_hysteresis",
    "storm_objects_watershed", "extract_patches", "points_in_polygons", "scored_rows", "calibrated_rows",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()[0]
    run(queries["confusion_counts"](spark, folder))
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(queries[name](spark, folder))
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(folder).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
