"""Partitioning into lanes that bound parallelism, and the edges that do it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dagloom.graph import TaskGraph
from dagloom.operators.traverse import by_strategy, is_acyclic, is_large, topo_order
from dagloom.operators.turns import lane_edges
from dagloom.plans.fixpoint import cut
from dagloom.plans.ranking import numbered


def lanes(g: TaskGraph, n_lanes: int = 4, order: str = "canonical", strategy: str = "auto") -> DataFrame:
    """(graph_id, node_id, level, lid, topo_id, lane): lane = lid mod n_lanes."""
    if n_lanes < 1:
        raise ValueError("there must be a lane")
    return topo_order(g, order, strategy).withColumn("lane", F.pmod("lid", F.lit(n_lanes)).cast("long"))


def lane_chains(laned: DataFrame, large: bool = False) -> DataFrame:
    """(graph_id, lane, src, dst): neighbours in a lane's order.  large: lanes
    are more than a task should hold; they are numbered over range partitions
    and each node finds the next number."""
    if large:
        placed = cut(numbered(laned.select("graph_id", "lane", "topo_id", "node_id"), ["graph_id", "lane"], ["topo_id"], "place"))
        after = placed.select("graph_id", "lane", (F.col("place") - 1).alias("place"), F.col("node_id").alias("dst"))
        return placed.join(after, ["graph_id", "lane", "place"]).select("graph_id", "lane", F.col("node_id").alias("src"), "dst")
    after = F.lead("node_id").over(Window.partitionBy("graph_id", "lane").orderBy("topo_id"))
    return laned.select("graph_id", "lane", F.col("node_id").alias("src"), after.alias("dst")).where("dst is not null")


def cross_edges(g: TaskGraph, laned: DataFrame, large: bool = False) -> DataFrame:
    """(graph_id, src, dst): edges between lanes that must be kept.  Of those
    from the lane of a node's last predecessor in another lane only that one
    stays, once.  large: a node's edges may be more than a task should hold, so
    its last predecessor is found by sums and joined."""
    a = laned.select("graph_id", F.col("node_id").alias("src"), F.col("lane").alias("lane_a"), F.col("topo_id").alias("t"))
    b = laned.select("graph_id", F.col("node_id").alias("dst"), F.col("lane").alias("lane_b"))
    across = g.edges.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"]).where("lane_a <> lane_b")
    if large:
        across = cut(across.select("graph_id", "src", "dst", "edge_seq", "lane_a", "t"))
        last = across.groupBy("graph_id", "dst").agg(F.max(F.struct("t", (-F.col("edge_seq")).alias("back"), "lane_a")).alias("m"))
        last = last.select("graph_id", "dst", F.col("m.t").alias("last_t"), (-F.col("m.back")).alias("last_seq"), F.col("m.lane_a").alias("last_lane"))
        found = across.join(last, ["graph_id", "dst"]).where("lane_a <> last_lane or (t = last_t and edge_seq = last_seq)")
        return found.select("graph_id", "src", "dst")
    last = Window.partitionBy("graph_id", "dst").orderBy(F.desc("t"), "edge_seq")
    across = across.withColumns({"r": F.row_number().over(last), "last_lane": F.first("lane_a").over(last)})
    return across.where("r = 1 or lane_a <> last_lane").select("graph_id", "src", "dst")


def lane_graph(g: TaskGraph, laned: DataFrame, strategy: str = "auto") -> TaskGraph:
    """Cross-lane edges and lane chains in place of the edges."""
    large = is_large(g, strategy)
    return TaskGraph(g.nodes, _numbered(cross_edges(g, laned, large).unionByName(lane_chains(laned, large).drop("lane")), large))


def lane_constraints(g: TaskGraph, laned: DataFrame, strategy: str = "auto") -> TaskGraph:
    """The edges with the lane chains added to them."""
    large = is_large(g, strategy)
    return TaskGraph(g.nodes, _numbered(g.edges.select("graph_id", "src", "dst").unionByName(lane_chains(laned, large).drop("lane")), large))


def limited_edges(g: TaskGraph, n_lanes: int, incremental: bool = False, strategy: str = "auto") -> DataFrame:
    """(graph_id, src, dst) of lane_graph over the canonical lanes, or, if
    incremental, of lane_constraints, for acyclic graphs: those that fit a task
    get order, lanes and edges there in one pass."""
    if n_lanes < 1:
        raise ValueError("there must be a lane")

    def loop(x: TaskGraph) -> DataFrame:
        laned = cut(lanes(x, n_lanes, strategy="loop"))
        limited = lane_constraints(x, laned, "loop") if incremental else lane_graph(x, laned, "loop")
        return limited.edges.select("graph_id", "src", "dst")

    return by_strategy(g, strategy, lambda a, b: lane_edges(a, b, n_lanes, not incremental), "graph_id long, src long, dst long", loop, listed=True)


def frozen_constraints(g: TaskGraph, first_run: DataFrame) -> TaskGraph:
    """The edges with the chains of an earlier run's lanes, as far as their
    nodes are still there; whether that has a cycle is for is_acyclic."""
    kept = first_run.join(g.nodes.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_semi")
    return lane_constraints(g, kept)


def union_edges(g: TaskGraph, extra: DataFrame) -> TaskGraph:
    return TaskGraph(g.nodes, _numbered(g.edges.select("graph_id", "src", "dst").unionByName(extra.select("graph_id", "src", "dst")), is_large(g)))


def union_acyclic(g: TaskGraph, extra: DataFrame, strategy: str = "auto") -> DataFrame:
    """(graph_id, acyclic) of the edges and more edges together."""
    return is_acyclic(union_edges(g, extra), strategy)


def order_certificate(edges: DataFrame, ordered: DataFrame) -> DataFrame:
    """(graph_id, agrees): whether all edges rise in topo_id, in one pass; if
    they do, there is no cycle."""
    at = lambda c: ordered.select("graph_id", F.col("node_id").alias(c), F.col("topo_id").alias(f"t_{c}"))
    worst = edges.join(at("src"), ["graph_id", "src"]).join(at("dst"), ["graph_id", "dst"]).groupBy("graph_id").agg(F.min((F.col("t_src") < F.col("t_dst")).cast("int")).alias("m"))
    return ordered.select("graph_id").distinct().join(worst, "graph_id", "left").select("graph_id", (F.coalesce("m", F.lit(1)) == 1).alias("agrees"))


def _numbered(edges: DataFrame, large: bool = False) -> DataFrame:
    """Numbers that only lists of edges need; what doesn't read them doesn't
    work them out.  Equal edges of large graphs get no order of their own."""
    if large:
        return edges.select("graph_id", F.monotonically_increasing_id().alias("edge_seq"), "src", "dst")
    order = Window.partitionBy("graph_id").orderBy("src", "dst")
    return edges.select("graph_id", (F.row_number().over(order) - 1).cast("long").alias("edge_seq"), "src", "dst")
