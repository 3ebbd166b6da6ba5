"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

NAMES = ("daily_bars", "ema", "tsi", "snapshot", "day_rank", "legacy_exit_flags", "fifo_closed", "stats_by_strategy", "breadth_gate", "weekly_signals", "trade_log", "hourly_bars")


def main() -> None:
    from pyspark.sql import SparkSession

    from barloom.plans.queries import queries

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, took = queries(), {}
    run = lambda name: known[name](spark, sf).write.format("noop").mode("overwrite").save()
    run("daily_bars")  # the first query of a session also starts it
    for name in sys.argv[1:] or NAMES:
        began = time.perf_counter()
        run(name)
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
