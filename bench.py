"""Time the headline queries and print one JSON line.

Data from $BENCH_SF_DIR, on local[$BENCH_CPUS].  Every query is run twice; the
second, warm time counts, the first is reported beside it.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlens.session import get_session  # noqa: E402
from workload import registry  # noqa: E402

HEADLINE = (
    "kpi_overview", "trend_month", "by_offering_type", "offering_metrics", "customer_metrics", "retention", "loss_items", "top_offerings",
    "metrics_daily", "top_customer_pct", "rule_insights", "offering_signals", "chart_sum", "daily_resample", "histogram20", "boxplot",
    "numeric_stats", "describe", "distinct_per_column", "corr_matrix", "iqr_outliers", "duplicates", "quality_score", "profile",
    "fill_median", "ffill", "interpolate", "cap_iqr", "dedupe_first", "classification_metrics", "roc_auc", "regression_metrics", "residuals",
    "link_overlap", "infer_relationships", "content_type", "persona", "column_mapping", "charts_business", "canonical_customers", "batch_score",
)


def run(spark, sf_dir: str, name: str) -> float:
    began = time.perf_counter()
    registry.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    cold, warm = {}, {}
    for name in sys.argv[1:] or HEADLINE:
        cold[name] = round(run(spark, sf_dir, name), 3)
        warm[name] = round(run(spark, sf_dir, name), 3)
    print(json.dumps({
        "metric": "headline_total_warm", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
