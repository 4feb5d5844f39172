"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dyad.plans import base  # noqa: E402
from dyad.plans.catalog import QUERIES, signals  # noqa: E402

HEADLINE = ["pair_universe", "pair_universe_orders", "top_pairs", "role_measures", "relational_pair",
            "relational_shrunk", "relational_blocks", "policy_residual_pair", "hand_tilt", "hidden_information",
            "pair_aggregate", "dyadic_residual", "partner_rank_gap", "within_pair", "episode_features",
            "candidate_features", "sequence_tokens", "bag_pooling", "knn_mean_distance", "average_precision",
            "paired_bootstrap", "pair_profile", "best_five"]
STAGES = {"log": base.log, "context": base.context, "seats": base.seats, "scored": base.scored,
          "live": base.live, "pair_hands": base.pair_hands, "signals": signals}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("dyad-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    # Shared tables are timed on their own: the first query to need one would pay for it.
    for name, build in STAGES.items():
        start = time.perf_counter()
        build(spark, sf_dir)
        times[f"stage_{name}"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
