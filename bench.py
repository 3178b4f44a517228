"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores, BENCH_RUNS how often each query is
run (the fastest counts). Every result is collected: it is small by design.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "desc_numeric", "desc_categorical_unique", "desc_top_values", "stat_moments",
    "stat_normality", "stat_percentiles", "dist_summary", "group_sizes", "group_stats",
    "quality_missing_total", "quality_duplicates", "quality_duplicates_subset",
    "quality_report", "outliers_iqr", "outliers_zscore", "corr_matrix", "rel_numeric",
    "rel_chi2", "rel_anova", "rel_all_lineitem", "schema_columns", "schema_constraints_num",
    "sample_rows", "insights", "warnings", "recommendations", "chart_histogram", "chart_line",
    "chart_bar", "chart_box", "chart_distribution", "chart_kde", "chart_pairplot",
    "analyze_comprehensive", "src_csv_roundtrip", "src_arrow_ipc",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from sondage.session import use_folder_below_warehouse
    from workload.queries import QUERIES

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # Call sites of every expression, for error messages only, double the planning time.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    use_folder_below_warehouse(spark)
    seconds = {}
    for name in chosen:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, folder).collect()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(min(taken), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
                "cpus": cpus,
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
