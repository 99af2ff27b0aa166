"""Convex clustering and the quotient graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dagloom.graph import TaskGraph
from dagloom.operators import kernels
from dagloom.operators.traverse import by_strategy, checked_levels, is_acyclic
from dagloom.plans.fixpoint import cut

CLUSTERED = "graph_id long, node_id long, cluster_id long"


def _loop_clusters(g: TaskGraph, size: int) -> DataFrame:
    """Level by level: nodes of a level that want one cluster are ranked by id;
    those beyond its room open clusters of their own, in id order."""
    nodes = cut(checked_levels(g, "loop"))
    by_id = Window.partitionBy("graph_id").orderBy("node_id")
    done = cut(nodes.where("level = 0").select("graph_id", "node_id", (F.row_number().over(by_id) - 1).cast("long").alias("cluster_id")))
    for level in range(1, (nodes.agg(F.max("level")).first()[0] or 0) + 1):
        here = nodes.where(F.col("level") == level).select("graph_id", F.col("node_id").alias("dst"))
        want = g.edges.join(here, ["graph_id", "dst"]).join(done.withColumnRenamed("node_id", "src"), ["graph_id", "src"])
        want = want.groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.max("cluster_id").alias("cluster_id"))
        held = done.groupBy("graph_id", "cluster_id").agg(F.count("*").alias("held"))
        top = done.groupBy("graph_id").agg(F.max("cluster_id").alias("top"))
        rank = F.row_number().over(Window.partitionBy("graph_id", "cluster_id").orderBy("node_id"))
        full = (F.col("rank") + F.col("held") > size).cast("long")
        opened = F.sum("full").over(Window.partitionBy("graph_id").orderBy("node_id"))
        new = want.join(held, ["graph_id", "cluster_id"]).join(top, "graph_id").withColumn("rank", rank).withColumn("full", full)
        new = new.select("graph_id", "node_id", F.when(F.col("full") == 1, F.col("top") + opened).otherwise(F.col("cluster_id")).alias("cluster_id"))
        done = cut(done.unionByName(new))
    return done


def convex_clusters(g: TaskGraph, size: int, strategy: str = "auto") -> DataFrame:
    """(graph_id, node_id, cluster_id): clusters of at most ``size`` nodes whose
    ids never decrease along an edge, so that the quotient has no cycle.  Nodes
    go in (level, node_id) order."""
    if size < 1:
        raise ValueError("a cluster holds at least one node")
    return by_strategy(g, strategy, lambda a, b: kernels.convex_clusters(a, b, size), CLUSTERED, lambda x: _loop_clusters(x, size))


def cluster_members(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("graph_id", "cluster_id").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("node_id")).alias("members"))


def quotient_edges(g: TaskGraph, clusters: DataFrame) -> DataFrame:
    """(graph_id, c_src, c_dst, multiplicity) of edges between clusters."""
    clusters = cut(clusters)  # it is joined twice
    ends = g.edges.join(clusters.select("graph_id", F.col("node_id").alias("src"), F.col("cluster_id").alias("c_src")), ["graph_id", "src"])
    ends = ends.join(clusters.select("graph_id", F.col("node_id").alias("dst"), F.col("cluster_id").alias("c_dst")), ["graph_id", "dst"])
    return ends.where("c_src <> c_dst").groupBy("graph_id", "c_src", "c_dst").agg(F.count("*").alias("multiplicity"))


def quotient(g: TaskGraph, clusters: DataFrame, dedupe: bool = True) -> TaskGraph:
    """Clusters as nodes.  dedupe=False keeps two edges for each crossing edge."""
    edges = quotient_edges(g, clusters)
    if not dedupe:
        edges = edges.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("multiplicity") * 2)))
    return TaskGraph.of(
        clusters.select("graph_id", F.col("cluster_id").alias("node_id")).distinct(),
        edges.select("graph_id", F.col("c_src").alias("src"), F.col("c_dst").alias("dst")),
    )


def quotient_acyclic(g: TaskGraph, clusters: DataFrame, strategy: str = "auto") -> DataFrame:
    """(graph_id, acyclic) of the quotient of any clustering."""
    return is_acyclic(quotient(g, clusters), strategy)
