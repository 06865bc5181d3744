"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is forced end to end with the ``noop`` sink (full execution, no collect).  The
canonical tables are rebuilt first and timed as ``build_tables``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pricewise.plans.registry import all_queries  # noqa: E402
from pricewise.session import build_session  # noqa: E402
from pricewise.sources.canonical import materialize  # noqa: E402

HEADLINE = ["price_trend", "market_analysis", "forecast_7d", "forecast_bands", "recommend", "latest_feature_row",
            "upsert_prices", "validate_prices", "reject_report", "rolling_mean_partial", "build_features_simple",
            "build_features_full", "regression_metrics", "dashboard_totals", "price_stats", "profile_numeric",
            "prediction_details", "avg_accuracy", "filter_contains", "paginate", "train_linear", "forecast_recursive",
            "lag_features_split", "rolling_mean_split", "generate_predictions", "stream_ingest_prices"]


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    extra = {"spark.driver.memory": "16g"}
    if os.environ.get("BENCH_EVENT_LOG"):
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": os.environ["BENCH_EVENT_LOG"]})
    spark = build_session(f"local[{cpus}]", "pricewise-bench", shuffle_partitions=int(cpus) * 2, extra=extra)
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    # warm session: JIT and the parquet reader paths, untimed
    spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    t0 = time.time()
    materialize(spark, sf, force=True)
    times["build_tables"] = round(time.time() - t0, 3)
    qs = all_queries()
    names = [n for n in HEADLINE if n in qs]
    if len(sys.argv) > 1:
        names = [n for n in names if any(p in n for p in sys.argv[1:])]
    for n in names:
        t = time.time()
        qs[n](spark, sf).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t, 3)
    total = round(sum(times.values()), 3)
    sfv = os.path.basename(sf.rstrip("/")).replace("sf", "")
    try:
        sfv = float(sfv)
    except ValueError:
        pass
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": sfv}))


if __name__ == "__main__":
    main()
