"""Times the headline queries; prints one JSON line. Settings: BENCH_SF_DIR, BENCH_CPUS."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from linewise.catalog.queries import QUERIES
from linewise.session import build_session

HEADLINE = [
    "describe_numeric", "distinct_counts", "null_counts", "median_fill", "kpis", "sales_by_productline",
    "sales_by_orderdate", "sales_by_country_productline", "dealsize_share", "sales_histogram", "qty_sales_grid",
    "qty_sales_corr", "top_orders", "top_customers", "customer_stats", "join_customer_stats", "join_product_stats",
    "date_parts_app", "features_notebook", "features_app", "label_encode", "train_test_split", "standard_scale",
    "median_fill_features", "cv_baselines", "metrics_by_split", "comparison_table", "residual_histogram",
    "scenario_estimates", "ols", "ridge", "describe_features", "label_encode_all", "actual_vs_predicted", "predictions_sink",
    "csv_roundtrip", "csv_malformed", "kpis_app", "sales_histogram_cleaned", "forest_stump",
    "exact_split", "date_format_counts", "csv_column_kinds",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    small = Path(folder).with_name("sf0.001")
    for name in names if small.is_dir() else []:  # JVM and code generation warm up on the smallest tables
        QUERIES[name](spark, str(small)).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
