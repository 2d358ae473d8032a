"""Times the headline queries on the tables in $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from loomgraph.plans import queries as engine

HEADLINE = ("incidents", "degrees", "tuples_view", "hyperedge_filter", "subgraph", "mask", "group_hyperedges", "mrt_all", "mrt_active_both", "collect_neighbors", "random_walk_3", "label_propagation_2", "laplacian_matvec", "bfs_sigma", "part_statistics", "gramian", "sliding_3")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    engine.QUERIES["num_vertices"](spark, sf_dir).collect()  # starts the session's threads
    took = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        engine.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - begin, 3)
    print(json.dumps({"metric": "hypergraph_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
