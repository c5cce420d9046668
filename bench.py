"""Benchmark: seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is forced end to end with the ``noop`` sink (every row computed,
nothing collected to the driver).  Prints ONE JSON line.

Besides the headline queries it records the two self-comparisons named in
(blocked kernel), and the grouping-sets report against one report per window.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "prepare_issues",
    "window_distribution",
    "overall_distribution",
    "model_frame",
    "report_by_window",
    "performance_timeline",
    "sample_balanced",
    "train_validation_split",
    "similarity_by_period",
    "similarity_by_period_max",
    "similarity_vs_f1",
    "yearly_spearman_r",
    "check_normality",
    "dtw_align",
    "tokenize_text",
]


def run_noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn) -> float:
    t0 = time.perf_counter()
    fn()
    return round(time.perf_counter() - t0, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from pyspark.sql import SparkSession

    from driftmon.session import ensure_checkpoint_dir

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("driftmon-bench")
        .config("spark.sql.shuffle.partitions", str(max(8, cpus * 2)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)

    from driftmon.operators import report as R
    from driftmon.plans.catalog import QUERIES, load_all
    from driftmon.sources import fixtures

    load_all()
    # warm-up: JVM class loading and Python worker start are not query time
    run_noop(QUERIES["confusion_counts"](spark, sf_dir))

    times = {}
    for name in HEADLINE:
        times[name] = timed(lambda n=name: run_noop(QUERIES[n](spark, sf_dir)))

    # self-comparison 2: one plan with grouping sets vs one report per window
    def per_window_reports():
        pred = fixtures.predictions(spark, sf_dir)
        periods = [r.period for r in pred.select("period").distinct().collect()]
        parts = [R.classification_report(pred.where(pred.period == p)) for p in periods]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        run_noop(out)

    extra = {}
    if os.environ.get("BENCH_LOOP_COMPARISON"):
        extra["report_per_window_loop"] = timed(per_window_reports)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "total_headline_seconds",
        "value": total,
        "unit": "sec",
        "queries": times,
        "comparisons": {
            "similarity_mean_centroid": times["similarity_by_period"],
            "similarity_max_blocked_pair_product": times["similarity_by_period_max"],
            "report_grouping_sets": times["report_by_window"],
            **extra,
        },
        "sf": os.path.basename(sf_dir).replace("sf", ""),
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
