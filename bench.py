"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS`` (default 8) choose data and threads.
Each query runs once to warm up and then ``BENCH_RUNS`` times (default 3) into the
``noop`` sink, so every row is computed and none is collected. The median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from ledgerlens.plans import catalog
from ledgerlens.sources.driver_tables import transactions

HEADLINE = [
    "f01_f07_engineered_features", "c01_clean", "e08_fit_transform", "d01_batch_score", "d09_explanation_text",
    "r11_ranked_risk_factors", "a01_numeric_describe", "a15_spearman", "p05_p07_consistency_report",
    "e09_stratified_split", "l03_alert_cooldown_batch", "j01_latest_outcome_join", "g04_decision_statistics",
    "t09_t10_metrics_by_model", "m03_j07_feature_drift", "m14_metric_summary", "s01_s05_csv_round_trip",
]
TRAINING = ["t02_logistic_regression", "t03_random_forest"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE + TRAINING:
        once = []
        for i in range((runs if name in HEADLINE else 1) + 1):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            once.append(time.perf_counter() - start)
        times[name] = round(statistics.median(once[1:]), 3)
    rows = transactions(spark, sf_dir).count()
    print(json.dumps({
        "metric": "total of median query times", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")), "transactions": rows, "cpus": int(cpus), "spark": spark.version,
        "shuffle_partitions": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
