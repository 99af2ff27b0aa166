"""Changes to graphs.  All random choices hash ids, so any engine repeats them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dagloom.functions.numbers import priority
from dagloom.graph import TaskGraph
from dagloom.operators.traverse import by_strategy, is_acyclic, topo_order
from dagloom.operators.turns import FOUND
from dagloom.operators.turns import turns as all_turns
from dagloom.plans.fixpoint import cut


def _next(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy("graph_id").agg((F.max(c) + 1).alias("next"))


def add_nodes(g: TaskGraph, new: DataFrame) -> TaskGraph:
    """new: (graph_id, node_id, name); they go to the end of the list."""
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy("node_id")) - 1
    rows = new.join(_next(g.nodes, "node_seq"), "graph_id", "left").select("graph_id", "node_id", "name", (F.coalesce("next", F.lit(0)) + rank).cast("long").alias("node_seq"))
    return TaskGraph(g.nodes.unionByName(rows), g.edges)


def add_edges(g: TaskGraph, new: DataFrame) -> TaskGraph:
    """new: (graph_id, src, dst); neither repeats nor cycles are looked for."""
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy("src", "dst")) - 1
    rows = new.join(_next(g.edges, "edge_seq"), "graph_id", "left").select("graph_id", (F.coalesce("next", F.lit(0)) + rank).cast("long").alias("edge_seq"), "src", "dst")
    return TaskGraph(g.nodes, g.edges.unionByName(rows))


def remove_edges(g: TaskGraph, gone: DataFrame) -> TaskGraph:
    """gone: (graph_id, edge_seq); an edge's equals stay."""
    return TaskGraph(g.nodes, g.edges.join(gone, ["graph_id", "edge_seq"], "left_anti"))


def remove_nodes(g: TaskGraph, gone: DataFrame) -> TaskGraph:
    """gone: (graph_id, node_id); their edges go with them."""
    at = lambda c: gone.select("graph_id", F.col("node_id").alias(c))
    edges = g.edges.join(at("src"), ["graph_id", "src"], "left_anti").join(at("dst"), ["graph_id", "dst"], "left_anti")
    return TaskGraph(g.nodes.join(gone, ["graph_id", "node_id"], "left_anti"), edges.select("graph_id", "edge_seq", "src", "dst"))


def pick(df: DataFrame, key: str, n: int, seed: int, turn: int | Column = 0) -> DataFrame:
    """n rows of each graph (all, if it has fewer), by the hash of their key."""
    order = Window.partitionBy("graph_id").orderBy(priority(F.col(key), turn, seed), key)
    return df.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).select("graph_id", key)


def remove_random_nodes(g: TaskGraph, n: int, seed: int = 42, turn: int = 0) -> TaskGraph:
    return remove_nodes(g, pick(g.nodes, "node_id", n, seed, turn))


def remove_random_edges(g: TaskGraph, n: int, seed: int = 42, turn: int = 0) -> TaskGraph:
    return remove_edges(g, pick(g.edges, "edge_seq", n, seed, turn))


def random_edges(g: TaskGraph, n: int, seed: int = 42, turn: int = 0, tries: int = 20, strategy: str = "auto") -> DataFrame:
    """(graph_id, src, dst): up to n new edges a graph, none there before, all
    rising in (level, node_id) order, so that no cycle comes.  ``tries`` * n +
    100 pairs of places are drawn by hash; the first that serve are taken."""
    return drawn_edges(g, cut(topo_order(g, strategy=strategy).select("graph_id", "node_id", "topo_id")), n, seed, turn, tries)


def drawn_edges(g: TaskGraph, ordered: DataFrame, n: int, seed: int = 42, turn: int = 0, tries: int = 20) -> DataFrame:
    """random_edges of a graph whose order is worked out already."""
    size = ordered.groupBy("graph_id").agg(F.count("*").alias("n")).where("n > 1")
    draw = size.select("graph_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tries * n + 99).cast("long"))).alias("try")) if n > 0 else size.where("false").withColumn("try", F.lit(0).cast("long"))
    a = F.pmod(priority(F.col("try") * 2, turn, seed), F.col("n") - 1)
    draw = draw.withColumn("i", a)
    draw = draw.withColumn("j", F.col("i") + 1 + F.pmod(priority(F.col("try") * 2 + 1, turn, seed), F.col("n") - 1 - F.col("i")))
    at = lambda c, to: ordered.select("graph_id", F.col("topo_id").alias(c), F.col("node_id").alias(to))
    found = draw.join(at("i", "src"), ["graph_id", "i"]).join(at("j", "dst"), ["graph_id", "j"])
    found = found.join(g.edges.select("graph_id", "src", "dst"), ["graph_id", "src", "dst"], "left_anti")
    found = found.groupBy("graph_id", "src", "dst").agg(F.min("try").alias("try"))
    order = Window.partitionBy("graph_id").orderBy("try")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).select("graph_id", "src", "dst")


def add_random_edges(g: TaskGraph, n: int, seed: int = 42, turn: int = 0, tries: int = 20) -> tuple[TaskGraph, DataFrame]:
    """The graph, and (graph_id, added)."""
    new = cut(random_edges(g, n, seed, turn, tries))
    return add_edges(g, new), new.groupBy("graph_id").agg(F.count("*").alias("added"))


def random_nodes(g: TaskGraph, n: int, seed: int = 42, turn: int = 0, prefix: str = "new") -> tuple[DataFrame, DataFrame]:
    """Nodes (graph_id, node_id, name), numbered from the graph's largest id on,
    and for each one edge (graph_id, src, dst) with an old node; hashes choose
    the old node and, by the coin of their parity, the direction."""
    size = g.nodes.groupBy("graph_id").agg(F.count("*").alias("n"), F.max("node_id").alias("top"))
    new = size.select("graph_id", "n", "top", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("i")) if n > 0 else size.where("false").withColumn("i", F.lit(0).cast("long"))
    new = new.withColumns({"node_id": F.col("top") + 1 + F.col("i"), "name": F.concat_ws("_", F.lit(prefix), F.col("n") + F.col("i"), F.col("i"))})
    place = (F.row_number().over(Window.partitionBy("graph_id").orderBy("node_id")) - 1).cast("long")
    old = g.nodes.select("graph_id", F.col("node_id").alias("old"), place.alias("place"))
    met = new.withColumn("place", F.pmod(priority(F.col("node_id"), turn, seed), F.col("n"))).join(old, ["graph_id", "place"])
    from_new = F.pmod(priority(F.col("node_id"), turn, seed + 1), F.lit(2)) == 0
    edges = met.select("graph_id", F.when(from_new, F.col("node_id")).otherwise(F.col("old")).alias("src"), F.when(from_new, F.col("old")).otherwise(F.col("node_id")).alias("dst"))
    return new.select("graph_id", "node_id", "name"), edges


def add_random_nodes(g: TaskGraph, n: int, seed: int = 42, turn: int = 0, prefix: str = "new") -> TaskGraph:
    nodes, edges = random_nodes(g, n, seed, turn, prefix)
    return add_edges(add_nodes(g, nodes), edges)


def sample_ints(spark: SparkSession, below: int, count: int, seed: int = 42) -> DataFrame:
    """count distinct integers of 0 .. below-1, by hash."""
    if count > below:
        raise ValueError("there are not that many")
    return spark.range(below).select(F.col("id").alias("value")).orderBy(priority(F.col("id"), 0, seed), "id").limit(count)


def parallelism_bounce(turn: int | Column, most: int = 8) -> int | Column:
    """most, .., 2, 1, 2, .., most, and again."""
    if isinstance(turn, int):
        return 1 + abs(most - 1 - turn % (2 * most - 2))
    return (F.lit(1) + F.abs(F.lit(most - 1) - F.pmod(turn, F.lit(2 * most - 2)))).cast("long")


def still_acyclic(g: TaskGraph, ordered: DataFrame, new: DataFrame, strategy: str = "auto") -> DataFrame:
    """(graph_id, acyclic) of g, by what has changed: ordered (graph_id,
    node_id, topo_id) is an order of g before the edges new (graph_id, src, dst)
    came, without the nodes that came since, which have one edge each.  If every
    new edge rises in it, no cycle has come; other graphs are looked through
    whole."""
    at = lambda c: ordered.select("graph_id", F.col("node_id").alias(c), F.col("topo_id").alias(f"t_{c}"))
    falls = new.join(at("src"), ["graph_id", "src"], "left").join(at("dst"), ["graph_id", "dst"], "left").where("not coalesce(t_src < t_dst, false)")
    suspect = cut(falls.select("graph_id").distinct())
    every = g.nodes.select("graph_id").distinct()
    if suspect.isEmpty():
        return every.withColumn("acyclic", F.lit(True))
    part = lambda df: df.join(suspect, "graph_id", "left_semi")
    found = is_acyclic(TaskGraph(part(g.nodes), part(g.edges)), strategy)
    return every.join(suspect, "graph_id", "left_anti").withColumn("acyclic", F.lit(True)).unionByName(found)


def incremental(g: TaskGraph, turns: int, n: int, seed: int = 42, strategy: str = "auto") -> Iterator[tuple[int, TaskGraph, DataFrame]]:
    """Rounds of change: n nodes go, n edges go, n edges come, n nodes come.
    Yields (round, graph, (graph_id, nodes, edges, acyclic)).  An order is
    worked out once a round: what goes leaves it valid, and what comes is held
    against it."""
    for turn in range(turns):
        g = remove_random_nodes(g, n, seed, turn)
        g = remove_random_edges(g, n, seed, turn)
        g = TaskGraph(cut(g.nodes), cut(g.edges))
        ordered = cut(topo_order(g, strategy=strategy).select("graph_id", "node_id", "topo_id"))
        stuck = cut(g.nodes.join(ordered, ["graph_id", "node_id"], "left_anti").select("graph_id").distinct())
        new = cut(drawn_edges(g, ordered, n, seed, turn))
        g = add_random_nodes(add_edges(g, new), n, seed, turn)
        g = TaskGraph(cut(g.nodes), cut(g.edges))
        fine = still_acyclic(g, ordered, new, strategy).join(stuck.withColumn("stuck", F.lit(True)), "graph_id", "left")
        fine = fine.select("graph_id", (F.col("acyclic") & F.col("stuck").isNull()).alias("acyclic"))
        e = g.edges.groupBy("graph_id").agg(F.count("*").alias("edges"))
        found = g.nodes.groupBy("graph_id").agg(F.count("*").alias("nodes")).join(e, "graph_id", "left").join(fine, "graph_id")
        yield turn, g, found.select("graph_id", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), "acyclic")


def incremental_stats(g: TaskGraph, turns: int, n: int, seed: int = 42, strategy: str = "auto") -> DataFrame:
    """(iter, graph_id, nodes, edges, acyclic) after each round of incremental.
    Graphs that fit a task go through all rounds there."""

    def loop(large: TaskGraph) -> DataFrame:
        out = None
        for turn, _, found in incremental(large, turns, n, seed, strategy):
            row = found.select(F.lit(turn).cast("long").alias("iter"), "*")
            out = row if out is None else out.unionByName(row)
        return out

    kernel = lambda a, b: all_turns(a, b, [0] * turns, n, seed, None)
    return by_strategy(g, strategy, kernel, FOUND, loop, listed=True)
