"""Task graphs as two DataFrames.

    nodes: graph_id, node_id, name, node_seq     node_seq: position in the list
    edges: graph_id, edge_seq, src, dst          edge_seq: position in the list

Many graphs are handled at once; ``graph_id`` goes through every operator.
Edges may repeat.  Graphs are values: mutations return new ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODES = "graph_id long, node_id long, name string, node_seq long"
EDGES = "graph_id long, edge_seq long, src long, dst long"


@dataclass(frozen=True)
class TaskGraph:
    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> TaskGraph:
        return TaskGraph(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))

    @staticmethod
    def of(nodes: DataFrame, edges: DataFrame) -> TaskGraph:
        """From nodes (graph_id, node_id[, name]) and edges (graph_id, src,
        dst), in the order of ids; equal edges stay apart."""
        by_node = Window.partitionBy("graph_id").orderBy("node_id")
        by_edge = Window.partitionBy("graph_id").orderBy("src", "dst")
        name = F.col("name") if "name" in nodes.columns else F.col("node_id").cast("string")
        long = lambda c: F.col(c).cast("long").alias(c)
        return TaskGraph(
            nodes.select(long("graph_id"), long("node_id"), name.alias("name"), (F.row_number().over(by_node) - 1).cast("long").alias("node_seq")),
            edges.select(long("graph_id"), (F.row_number().over(by_edge) - 1).cast("long").alias("edge_seq"), long("src"), long("dst")),
        )

    @staticmethod
    def from_lists(spark: SparkSession, nodes: list[int] | list[tuple[int, int]], edges: list[tuple[int, ...]]) -> TaskGraph:
        """Programmatic construction: node ids, or (graph, id); edges (src, dst)
        or (graph, src, dst), in list order."""
        ns = [(0, n) if isinstance(n, int) else n for n in nodes]
        es = [(0, *e) if len(e) == 2 else e for e in edges]
        return TaskGraph(
            spark.createDataFrame([(g, n, f"n{n}", k) for k, (g, n) in enumerate(ns)], NODES),
            spark.createDataFrame([(g, k, a, b) for k, (g, a, b) in enumerate(es)], EDGES),
        )


@dataclass(frozen=True)
class UndirectedGraph:
    """vertices(v) and edges(src, dst), each edge in both directions, without
    loops and repeats."""

    vertices: DataFrame
    edges: DataFrame

    @staticmethod
    def of(vertices: DataFrame, pairs: DataFrame) -> UndirectedGraph:
        both = pairs.select("src", "dst").union(pairs.select("dst", "src")).where("src <> dst").distinct()
        return UndirectedGraph(vertices.select("v").distinct(), both)


@dataclass(frozen=True)
class Hypergraph:
    """vertices(v) and members(e, v): the vertices of each hyperedge, each once.
    Vertices of one hyperedge are neighbours."""

    vertices: DataFrame
    members: DataFrame
