"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from tickerloom.catalog import all_queries
from tickerloom.session import build_session

HEADLINES = (
    "technical_leaders",
    "technical_score_history",
    "macd_ema",
    "event_radar",
    "relative_strength",
    "global_correlation",
    "market_regime",
    "event_risk",
    "forward_outcome",
    "reliability_scorecard",
    "walk_forward_backtest",
    "component_skill",
    "weighted_opportunity",
    "candidate_gate",
    "expiry_metrics",
    "chain_greeks",
    "expiry_ideas",
    "iv_rank",
    "option_premium_outcome",
    "merged_headlines",
    "entity_relevance",
    "policy_impacts",
    "evidence_log",
    "paper_ledger",
    "full_scan",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    # start the JVM's code paths once, so that the first query is not charged for them
    queries["asset_list"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
