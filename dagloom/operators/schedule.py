"""Execution plans: which node runs in which wave, in which slot.

In every plan an edge leads to a later wave, and a wave has no more rows than
the parallelism allows.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dagloom.functions.numbers import checksum
from dagloom.graph import TaskGraph
from dagloom.operators.cluster import quotient
from dagloom.operators.lanes import lane_constraints, lane_graph, lanes
from dagloom.operators.mutate import incremental, parallelism_bounce
from dagloom.operators.traverse import by_strategy, levels, topo_order
from dagloom.operators.turns import RUNS, lane_waves
from dagloom.operators.turns import turns as all_turns
from dagloom.plans.fixpoint import cut


def schedule(g: TaskGraph, max_parallelism: int | None = None, strategy: str = "auto") -> DataFrame:
    """(graph_id, node_id, wave, slot): levels, in lots of max_parallelism."""
    if max_parallelism is not None and max_parallelism < 1:
        raise ValueError("something must be let run")
    ordered = topo_order(g, strategy=strategy)
    if max_parallelism is None:
        return ordered.select("graph_id", "node_id", F.col("level").alias("wave"), F.col("lid").alias("slot"))
    return in_lots(ordered, max_parallelism)


def in_lots(ordered: DataFrame, max_parallelism: int) -> DataFrame:
    """The schedule of an order that is worked out already."""
    if max_parallelism < 1:
        raise ValueError("something must be let run")
    k = F.lit(max_parallelism)
    lots = ordered.groupBy("graph_id", "level").agg(F.ceil(F.count("*") / k).alias("lots"))
    before = F.coalesce(F.sum("lots").over(Window.partitionBy("graph_id").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = lots.select("graph_id", "level", before.cast("long").alias("base"))
    return ordered.join(base, ["graph_id", "level"]).select(
        "graph_id", "node_id", (F.col("base") + F.floor(F.col("lid") / k)).cast("long").alias("wave"), F.pmod("lid", k).cast("long").alias("slot")
    )


def schedule_clusters(g: TaskGraph, clusters: DataFrame, matrix_size: int = 8, strategy: str = "auto") -> DataFrame:
    """(graph_id, cluster_id, wave, tasks, total): a cluster runs its members'
    payloads; total is the sum of their checksums."""
    wave = levels(quotient(g, clusters), strategy).select("graph_id", F.col("node_id").alias("cluster_id"), F.col("level").alias("wave"))
    tasks = clusters.groupBy("graph_id", "cluster_id").agg(F.count("*").alias("tasks"))
    return wave.join(tasks, ["graph_id", "cluster_id"]).withColumn("total", F.col("tasks") * checksum(matrix_size))


def schedule_lanes(g: TaskGraph, laned: DataFrame, incremental: bool = False, strategy: str = "auto") -> DataFrame:
    """(graph_id, node_id, wave, slot): levels over the lanes' edges, or, if
    incremental, over the edges with the lanes' chains; slot is the lane."""
    laned = cut(laned)  # what follows reads it several times
    limited = lane_constraints(g, laned, strategy) if incremental else lane_graph(g, laned, strategy)
    waves = levels(limited, strategy, like=g).withColumnRenamed("level", "wave")
    return waves.join(laned.select("graph_id", "node_id", F.col("lane").alias("slot")), ["graph_id", "node_id"])


def run_lanes(g: TaskGraph, n_lanes: int, incremental: bool = False, strategy: str = "auto") -> DataFrame:
    """schedule_lanes over the canonical lanes, for acyclic graphs: those that
    fit a task get order, lanes and waves there in one pass."""
    if n_lanes < 1:
        raise ValueError("there must be a lane")
    loop = lambda x: schedule_lanes(x, lanes(x, n_lanes, strategy="loop"), incremental, "loop").select("graph_id", "node_id", "wave", "slot")
    return by_strategy(g, strategy, lambda a, b: lane_waves(a, b, n_lanes, not incremental), "graph_id long, node_id long, wave long, slot long", loop, listed=True)


def run_totals(plan: DataFrame, matrix_size: int = 8) -> DataFrame:
    """(graph_id, waves, tasks, widest, total) of a plan, total being the sum
    of the payloads' checksums."""
    waves = plan.groupBy("graph_id", "wave").agg(F.count("*").alias("n"))
    return waves.groupBy("graph_id").agg(F.count("*").alias("waves"), F.sum("n").alias("tasks"), F.max("n").alias("widest")).withColumn("total", F.col("tasks") * checksum(matrix_size))


def incremental_runs(g: TaskGraph, mode: str, turns: int, n: int, most: int = 8, seed: int = 42, matrix_size: int = 8, strategy: str = "auto") -> DataFrame:
    """(iter, k, graph_id, waves, tasks, widest, total, nodes, edges): in each
    turn the graph runs with parallelism k, is changed (see ``incremental``) and
    looked through for cycles, and k bounces between most and 1; nodes and
    edges are those after the change.  mode: "semaphore" lets k tasks run,
    "lanes" runs k lanes, and "lanes-incremental" the edges with the lanes'
    chains.  A cycle ends the loop with an error, and so does a mode of another
    name.  Graphs that fit a task go through all turns there."""
    plans = {
        "semaphore": lambda g, k: schedule(g, k, strategy),
        "lanes": lambda g, k: schedule_lanes(g, lanes(g, k, strategy=strategy), strategy=strategy),
        "lanes-incremental": lambda g, k: schedule_lanes(g, lanes(g, k, strategy=strategy), incremental=True, strategy=strategy),
    }
    if mode not in plans:
        raise ValueError(f"no such mode: {mode}")
    names = [c.split()[0] for c in RUNS.split(", ")]
    parallel = [parallelism_bounce(turn, most) for turn in range(turns)]

    def loop(large: TaskGraph) -> DataFrame:
        out, changes = None, incremental(large, turns, n, seed, strategy)
        for turn, k in enumerate(parallel):
            ran = cut(run_totals(plans[mode](large, k), matrix_size))
            _, large, found = next(changes)
            row = ran.drop("total").join(cut(found), "graph_id", "left").withColumn("acyclic", F.coalesce("acyclic", F.lit(True)))
            row = row.select(F.lit(turn).cast("long").alias("iter"), F.lit(k).cast("long").alias("k"), *row.columns).select(*names)
            out = row if out is None else out.unionByName(row)
        return out

    found = by_strategy(g, strategy, lambda a, b: all_turns(a, b, parallel, n, seed, mode), RUNS, loop, listed=True)
    stuck = F.raise_error(F.concat(F.lit("the graph has a cycle after turn "), F.col("iter").cast("string"))).cast("long")
    total = F.when(F.col("acyclic"), F.col("tasks") * checksum(matrix_size)).otherwise(stuck)
    return found.withColumn("total", total).drop("acyclic")


def timed(spark: SparkSession, phases: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """(phase, rows, us): runs each phase's plan and times it."""
    out = []
    for name, make in phases.items():
        began = time.perf_counter()
        rows = make().count()
        out.append((name, rows, int((time.perf_counter() - began) * 1e6)))
    return spark.createDataFrame(out, "phase string, rows long, us long")
