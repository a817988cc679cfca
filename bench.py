"""Times headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])
os.environ.setdefault("OMP_NUM_THREADS", "1")

HEADLINE = (
    "edge_transition_counts",
    "jtt_ipw_rate_matrix",
    "co_transition_counts_edge",
    "quantized_shipment_times",
    "hamming_pairs",
    "cherrypp_transition_counts",
    "cherrypp_co_transition_counts",
    "site_rate_argmax",
    "site_counts_regularized",
    "fast_cherries_tree",
    "pruning_loglik",
    "learned_rate_matrix",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from strandmill.plans.catalog import QUERIES

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took, spread = {}, {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):  # the first run compiles
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(min(runs), 3)
        spread[name] = round(abs(runs[-1] - runs[-2]), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "spread": spread, "sf": Path(folder).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
