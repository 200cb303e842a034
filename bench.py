"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from feldspark.plans import load_catalog  # noqa: E402
from feldspark.session import local_session  # noqa: E402

HEADLINE = [
    "url_features",
    "url_root_domain",
    "profile_numeric",
    "profile_cardinality",
    "histograms",
    "impute_mean_median",
    "ts_ffill_by_user",
    "outlier_iqr",
    "outlier_treat",
    "encode_target",
    "encode_hash",
    "scale_robust",
    "fe_text",
    "rfm",
    "split_holdout",
    "split_kfold",
    "leak_rows",
    "leak_ks",
    "best_threshold",
    "class_metrics",
    "oversample",
    "knn_join_events",
    "gbt",
    "batch_score",
]


def run(spark, fn, folder: str, rounds: int) -> float:
    times = []
    for _ in range(rounds):
        start = time.perf_counter()
        fn(spark, folder).write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - start)
        spark.catalog.clearCache()
    return statistics.median(times)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    rounds = int(os.environ.get("BENCH_ROUNDS", "3"))
    chosen = sys.argv[1:] or HEADLINE
    spark = local_session(cores, "feldspark-bench", spark__ui__showConsoleProgress="false")
    queries = load_catalog().QUERIES
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in chosen:
        run(spark, queries[name], folder, 1)  # warm-up: code generation and Python workers
        seconds[name] = round(run(spark, queries[name], folder, rounds), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries (median of warm runs)",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
