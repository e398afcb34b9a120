"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark import session  # noqa: E402
from tidemark.plans import catalog  # noqa: E402

HEADLINES = (
    "candles_by_symbol hourly_grid features_view_join asof_latest rolling_vol bollinger ema_family rsi_ml atr order_flow_buckets volume_profile poc "
    "value_area cvd_daily_reset cascade_flags distribution_stats corr_pairs spearman_rank winsor_impute audit_report barrier_label regime_metrics "
    "threshold_sweep rollup_totals tokenize_counts bm25_topk dense_topk rrf_fusion diverse_topk chunks memory_buffer stream_candles_complete"
).split()


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session.build(
        f"local[{cpus}]", "bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    took = {}
    for name in HEADLINES:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
