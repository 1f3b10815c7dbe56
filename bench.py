"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR   table directory (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 8)
    BENCH_QUERIES  comma-separated keys (default: the headline set)
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "flagship_blend_min_dcf", "i1_min_dcf", "i3_roc_points", "i9_paired_stability", "i11_metric_bundle",
    "f8_alpha_grid", "k16_select_alpha", "k17_select_weights", "k20_cluster_alphas", "k22_routed_score",
    "a3_manifest_integrity", "a8_template_order", "a18_missing_features", "c1_wav_walk", "g8_header_medians",
    "h1_hash_bottom_k", "h2_round_robin", "h3_balanced_sample", "j2_group_split", "j5_label_folds",
    "d10_flux", "d15_linear_cepstra", "d16_first_delta", "e2_delta_vector", "e3_ordered_windows",
    "e5_temporal_vector", "e7_encoding_traces", "e_clip_views",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("clipscore-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    if "spark.checkpoint.dir" not in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    from clipscore.catalog import all_queries

    queries = all_queries()
    picks = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or list(HEADLINE)
    queries["i4_roc_auc"](spark, sf).collect()  # start the JVM paths once
    times = {}
    for key in picks:
        start = time.perf_counter()
        queries[key](spark, sf).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
