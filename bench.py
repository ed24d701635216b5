"""Headline queries on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from recurra.plans.catalog import QUERIES  # noqa: E402
from recurra.session import build_session  # noqa: E402

HEADLINE = (
    "describe",
    "preprocess_segment",
    "mutual_information",
    "autocorrelation",
    "false_neighbors",
    "long_parameters",
    "long_false_neighbors",
    "long_gray_counts",
    "rp_epsilon",
    "rqa_image",
    "glcm_features",
    "lbp_features",
    "stat_features",
    "wavelet_features",
    "gabor_responses",
    "tamura_features",
    "combined_ranking",
    "correlation_matrix",
    "silhouette",
    "knn_classifier",
    "gaussian_nb",
    "model_random_forest",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/events.parquet").count()  # start the executors
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
