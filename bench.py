"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from roleweave.catalog import load_all
from roleweave.session import get_spark, ship

HEADLINE = [
    "baseline_scores",
    "text_scores",
    "train_test_split",
    "count_vectors",
    "association_ranks",
    "score_model_mentions",
    "lexicon_match",
    "tree_roots",
    "clause_constraints",
    "event_coefficients",
    "event_deflections",
    "deflection_model_mentions",
    "dimension_covariance",
    "pair_similarities",
    "point_densities",
    "order_part_components",
    "association_chain",
    "sentiment_chain",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(2 * int(cpus) if cpus.isdigit() else 16),
            "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "12g"),
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    proofs = load_all()
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        proofs[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rsplit("/", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
