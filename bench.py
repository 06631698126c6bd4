"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tidemark import registry

HEADLINE = [
    "flagship_pricing", "volatility", "price_returns", "trend_quality", "price_volume", "market_beta", "breadth", "cross_sectional_rank", "liquidity", "technical", "draw_range", "multi_day_returns", "daily_beta", "trade_agg_minute", "tick_run_features",
    "asof_backward", "news_sentiment", "parity_diff", "symbol_day_clean", "ls_backtest_per_name", "newey_west_t", "swing", "swing_dc", "scan_features",
]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = registry.queries(), {}
    queries["flagship_pricing"](spark, sf).count()  # starts the session
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
