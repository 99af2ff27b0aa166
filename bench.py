"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores.  Each query runs once to warm up and then BENCH_RUNS times
(default 3); the median counts.  rounds: of DataFrame jobs that a loop took;
queries without a number go through their graphs in one pass.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, os.environ.get("PYTHONPATH", "")])

QUERIES = (
    "levels",
    "topo_fifo",
    "lane_graph",
    "convex_clusters",
    "schedule_semaphore",
    "schedule_lanes",
    "quotient_edges",
    "mis_greedy",
    "mis_luby",
    "incremental_stats",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from dagloom.operators import mis
    from dagloom.queries import spark_queries
    from dagloom.sources.tables import part_orders

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="bench-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = spark_queries(), {}
    for name in QUERIES:
        times = []
        for _ in range(1 + runs):
            began = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 3)
    rounds = {f"mis_{algo}": mis.rounds(part_orders(spark, sf), algo) for algo in ("greedy", "luby")}
    spark.stop()
    print(json.dumps({"metric": "task-graph queries, median seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "rounds": rounds, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
