"""Timings of headline queries: prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1) and ``BENCH_CPUS`` the local cores.
Names given as arguments restrict the run.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINES = [
    "flagship_selected_degrees",
    "agg_1_canonical_edges",
    "win_1_top_percent_edges",
    "win_2_nearest_edges",
    "agg_18_threshold_sweep",
    "gr_1_jaccard_edges",
    "gr_5_connected_components",
    "san_6_sanitized_records",
    "src_9_strict_hit_table",
    "pred_11_three_valued",
    "agg_8_frequency_search",
    "agg_10_subset_residues_groups",
    "agg_13_identity_weights",
    "agg_14_logo_bits",
    "join_8_similar_pairs",
    "agg_21_similarity_percentile",
    "join_8_alignment_network",
    "win_4_ranked_hits",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("simloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="simloom-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from simloom.catalog import QUERIES

    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not part of any query
    seconds = {}
    for name in sys.argv[1:] or HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
