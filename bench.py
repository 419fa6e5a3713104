"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from marketlab.plans import QUERIES

HEADLINE = [
    "regime_returns", "ticks_to_bars", "ohlcv_features", "param_rule_entries", "chart_patterns", "strategy_scores", "composite_vote",
    "rule_backtest", "walk_forward_summary", "asof_decision", "nearest_decision", "first_touch_exits", "mae_join", "pair_spread",
    "label_maturation", "arm_posteriors", "tearsheet_overall", "tearsheet_slices", "trade_analytics", "protection_locks",
    "order_vwap", "pbo_cscv", "bootstrap_ci", "direction_edge", "rank_ic", "psi_drift", "conformal_quantile", "lexicon_sentiment",
    "mention_heat", "evidence_match", "html_strip", "forecast_metrics",
]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
             .config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["ticks_to_bars"](spark, d).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t = time.time()
        QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(d.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
