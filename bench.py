"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from tapeworks.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "ohlc_1m", "ohlc_1h", "resample_fanout", "dq_report", "ema_first_seed", "tsi", "supertrend",
    "bos_order_block", "ema_cross_signals", "gold_pullback", "backtest_trades", "backtest_metrics",
    "parameter_sweep", "engine_trades_range", "asof_multi_tf", "news_blackout", "triple_barrier",
    "confluence_scan", "ledger_metrics", "ledger_by_year_rollup", "cost_stress", "daily_risk_ledger",
    "mc_drawdown_p95", "campaign_dsr", "gate_decisions", "wilson_confidence", "fanout_match",
    "repeat_suppression",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("tapeworks-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("ohlc_1h", "ema_first_seed"):  # warm the JVM and the Python workers
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
