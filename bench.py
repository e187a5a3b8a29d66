"""Runs headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from riskgraph.plans.registry import QUERIES

HEADLINE = [
    "causal_prior_count_amt", "causal_velocity", "causal_label_lag_rate", "entity_report", "temporal_split_labels", "connected_components_pair",
    "ring_distinct_entities", "graph_stats", "correlation_matrix", "rules_baseline", "pr_auc", "slice_amount_band", "psi_drift", "noisy_or_case_score",
    "case_rollup", "policy_argmin", "case_queue_topn", "ledger_verify",
]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["prepare_time_parts"](spark, sf).count()  # start-up is no query's cost
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total wall-clock", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
