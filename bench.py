"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oddsloom.plans import all_queries  # noqa: E402
from oddsloom.session import local_session  # noqa: E402

HEADLINE = (
    "forecast_method_scores", "calibration_table", "macro_auc", "fair_power", "fair_shin", "market_consensus",
    "derived_market_probs", "top_score_hits", "fold_training_sums", "strength_fit", "walk_forward_backtest",
    "fixture_scoring", "w_xi_grid", "rolling_form", "feature_table", "match_ratings", "xg_tolerance_join",
    "nearest_result", "latest_complete_snapshot", "best_price_as_of", "match_upsert", "snapshot_insert_or_ignore",
    "bootstrap_paired_gap", "permutation_p_value", "composite_grid", "blend_by_age", "exposure_cap", "settled_bets",
    "scan_result_files", "scan_odds_snapshots",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINE
    queries = all_queries()
    spark.read.parquet(f"{folder}/orders.parquet").count()  # start the JVM's readers before the clock
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        # a full evaluation without pulling the rows to the driver
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")), "spark": spark.version,
        "cores": spark.sparkContext.defaultParallelism, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }))


if __name__ == "__main__":
    main()
