"""Time the headline queries at one scale; prints one JSON line.

``BENCH_SF_DIR`` is the data folder, ``BENCH_CPUS`` the number of local cores.
Each query is run to a no-op sink, so all rows and columns are computed. A first
untimed run at the same scale warms the JVM and the Python workers.
"""

import json
import os
import re
import time

from surtido.plans.queries import QUERIES
from surtido.session import build_session

HEADLINE = [
    "profitability", "eoq", "rotation", "efficiency", "abc_api", "abc_detail", "pair_demand",
    "daily_series", "daily_by_store", "store_type_summary", "inventory_by_store", "sku_rollup",
    "compliance_stores", "compliance_trend", "compliance_tiers", "compliance_report", "target_calendar",
    "basket_pairs", "basket_rules", "anomaly_features", "anomalies", "risk_stats", "stockout_risk",
    "forecast", "predict_features", "predict", "store_metrics", "store_segments_simple",
    "incremental_load", "inventory_update", "stream_ingest", "stream_daily_sales",
]


def run(spark, name, sf_dir):
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", cpus, spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    cold = {name: run(spark, name, sf_dir) for name in names}
    warm = {name: run(spark, name, sf_dir) for name in names}
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_warm_seconds", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "cold": cold, "cold_total": round(sum(cold.values()), 3),
        "sf": float(scale.group(1)) if scale else None, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
