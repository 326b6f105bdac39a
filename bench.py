"""Wall time of the headline queries: one JSON line on stdout.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS].
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "a01_scan_days",
    "d09_rolling",
    "d10_patches",
    "d14_order_flow_dynamics",
    "d17_trade_impact_dynamics",
    "d18_cross_zscores",
    "d19_cross_ranks",
    "d22_momentum_interactions",
    "d26_regime_states",
    "d34_micro_zscores",
    "d39_raw_channels",
    "e05_features_for_groups",
    "flagship_daily_ic",
    "g03_winsorized_labels",
    "h01_ridge",
    "i02_windows",
    "i07_padded_batches",
    "j03_daily_ic",
    "j12_leaderboard",
    "k03_weighted_blend",
    "k07_postprocess_grid",
    "k08_weight_sweep",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("barspan-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        # Local files are far below the advisory partition size; without this the
        # window stages of a small panel would be merged into one or two tasks.
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    from barspan.queries.registry import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    chosen = sys.argv[1:] or HEADLINES
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    seconds = {}
    for name in chosen:
        started = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
