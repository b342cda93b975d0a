"""Headline timings: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from rankfield import inputs  # noqa: E402
from rankfield.catalog import entries  # noqa: E402
from rankfield.catalog.tables import enrich_matrix, enrich_ranked  # noqa: E402

OPERATORS = (
    "signal_to_noise",
    "spearman_sparse",
    "collapse_median",
    "rank_features",
    "enrichment_score",
    "running_es_full",
    "null_es_by_random_sets",
    "fdr_q",
    "co_member_pairs",
    "jaccard_matrix",
    "correlation_clusters",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = entries()
    plan = {name: registered[name].query for name in OPERATORS}
    for n in (100, 1000):
        plan[f"enrich_ranked_{n}"] = lambda s, d, n=n: enrich_ranked(s, d, n).results
        plan[f"enrich_matrix_{n}"] = lambda s, d, n=n: enrich_matrix(s, d, n).results
    inputs.ranked(spark, sf_dir).count()  # start the JVM and the workers
    seconds = {}
    for name, query in plan.items():
        start = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
