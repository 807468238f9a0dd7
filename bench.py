"""Time the headline queries; prints one JSON line."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from quillgraph.plans.catalog import QUERIES

HEADLINE = ("stock_stats", "dashboard_totals", "top_symbols", "sentiment_score", "event_detection", "graph_edges", "degree_centrality", "comention_first_seen", "history_counts", "industry30", "moving_average", "volatility20", "asof_label", "abnormal_return", "overall_metrics", "spearman", "classification_metrics", "sliding_rate")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    tmp = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", f"{tmp}/warehouse").config("spark.checkpoint.dir", f"file://{tmp}/shared").config("spark.log.level", "ERROR").getOrCreate()
    )
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):  # the first run compiles
            began = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(min(runs), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
