"""Levels, topological orders, reachability and cycle tests.

``strategy``: "grouped" runs a kernel over buckets of whole graphs, in one
pass whatever their depth; "loop" is for graphs that no task should hold: it
contracts chains, runs DataFrame rounds over what remains, and ends in a task
once the rest fits one; "auto" gives each graph the one that fits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from weakref import WeakKeyDictionary

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dagloom.graph import TaskGraph
from dagloom.operators import kernels
from dagloom.plans.fixpoint import cut
from dagloom.plans.ranking import numbered

#: Graphs with more nodes and edges than this are looped over as DataFrames.
TASK_ROWS = 2_000_000
#: Rows of nodes and edges that a bucket is meant to have.
BUCKET_ROWS = 200_000
#: Rounds of a loop at most, and rounds after which edges that were passed go.
MOST_ROUNDS = 1_000_000
SHRINK = 4
#: Share of the nodes that may be left when leaves are peeled off.
CORE = 0.75

ORDERED = "graph_id long, node_id long, level long, lid long, topo_id long"


def stats(g: TaskGraph) -> DataFrame:
    n = g.nodes.groupBy("graph_id").agg(F.count("*").alias("num_nodes"))
    e = g.edges.groupBy("graph_id").agg(F.count("*").alias("num_edges"))
    return n.join(e, "graph_id", "left").select("graph_id", "num_nodes", F.coalesce("num_edges", F.lit(0)).alias("num_edges"))


def degrees(g: TaskGraph) -> DataFrame:
    ends = g.edges.select("graph_id", F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
                                                        F.struct(F.col("dst").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    sums = ends.groupBy("graph_id", "x.node_id").agg(F.sum("x.i").alias("i"), F.sum("x.o").alias("o"))
    out = g.nodes.join(sums, ["graph_id", "node_id"], "left")
    return out.select("graph_id", "node_id", F.coalesce("i", F.lit(0)).alias("num_fanins"), F.coalesce("o", F.lit(0)).alias("num_fanouts"))


def sources(g: TaskGraph) -> DataFrame:
    return g.nodes.join(g.edges.select("graph_id", F.col("dst").alias("node_id")), ["graph_id", "node_id"], "left_anti").select("graph_id", "node_id")


def sinks(g: TaskGraph) -> DataFrame:
    return g.nodes.join(g.edges.select("graph_id", F.col("src").alias("node_id")), ["graph_id", "node_id"], "left_anti").select("graph_id", "node_id")


def grouped(g: TaskGraph, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, rows: int | None = None, listed: bool = False) -> DataFrame:
    """The kernel over buckets of whole graphs; rows: of the graph, if known;
    listed: whether the kernel looks at the places in the lists of nodes and
    edges, which otherwise needn't be worked out."""
    rows = g.nodes.count() + g.edges.count() if rows is None else rows
    spark = g.nodes.sparkSession
    buckets = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 5_000 + 1), rows // BUCKET_ROWS + 1)
    bucket = F.pmod(F.xxhash64("graph_id"), F.lit(buckets)).alias("bucket")
    unused = ["name"] if listed else ["name", "node_seq", "edge_seq"]
    keyed = lambda df: df.select(bucket, *[F.col(c).alias(c) for c in df.columns if c not in unused]).groupBy("bucket")
    return keyed(g.nodes).cogroup(keyed(g.edges)).applyInPandas(lambda a, b: kernel(a, b) if len(a) else kernel(a, b).iloc[:0], schema)


_SIZES: WeakKeyDictionary = WeakKeyDictionary()


def sizes(g: TaskGraph) -> tuple[int, int]:
    """Nodes and edges of all graphs, and of the largest; counted once."""
    if g not in _SIZES:
        rows = stats(g).select((F.col("num_nodes") + F.col("num_edges")).alias("rows"))
        total = rows.agg(F.sum("rows").alias("n"), F.max("rows").alias("m")).first()
        _SIZES[g] = total["n"] or 0, total["m"] or 0
    return _SIZES[g]


def is_large(g: TaskGraph, strategy: str = "auto") -> bool:
    """Whether some graph should not be held by one task."""
    return strategy == "loop" or strategy == "auto" and sizes(g)[1] > TASK_ROWS


def by_strategy(g: TaskGraph, strategy: str, kernel: Callable, schema: str, loop: Callable[[TaskGraph], DataFrame], like: TaskGraph | None = None, listed: bool = False) -> DataFrame:
    """like: a graph of about the same sizes whose rows are cheaper to count."""
    if strategy == "loop":
        return loop(g)
    if strategy == "grouped":
        return grouped(g, kernel, schema, listed=listed)
    if strategy != "auto":
        raise ValueError(f"no such strategy: {strategy}")
    total, most = sizes(like or g)
    if most <= TASK_ROWS:
        return grouped(g, kernel, schema, total, listed)
    if most == total:  # there is only one
        return loop(g)
    large = stats(like or g).where(F.col("num_nodes") + F.col("num_edges") > TASK_ROWS).select("graph_id")
    part = lambda how: TaskGraph(g.nodes.join(large, "graph_id", how), g.edges.join(large, "graph_id", how))
    return grouped(part("left_anti"), kernel, schema, listed=listed).unionByName(loop(part("left_semi")))


def _check_ends(g: TaskGraph) -> None:
    ends = g.edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id"))
    if not ends.join(g.nodes, ["graph_id", "node_id"], "left_anti").isEmpty():
        raise ValueError("an edge names no node")


@dataclass(frozen=True)
class Contracted:
    """A graph with each chain as one node: places (graph_id, node_id, chain_id,
    place, ring) and edges (graph_id, src, dst, w) between chains, w being the
    length of the one they leave.  Edges that are not in a chain lead from the
    last node of one to the first of another."""

    places: DataFrame
    edges: DataFrame


def _contracted(g: TaskGraph) -> Contracted:
    _check_ends(g)
    places = cut(_loop_chains(g))
    at = lambda c, to, *more: places.select("graph_id", F.col("node_id").alias(c), F.col("chain_id").alias(to), *more)
    ends = g.edges.join(at("src", "a", (F.col("place") + 1).alias("w"), "ring"), ["graph_id", "src"]).where("not ring")
    ends = ends.join(at("dst", "b", F.col("place").alias("to")), ["graph_id", "dst"]).where("to = 0")
    return Contracted(places, cut(ends.select("graph_id", F.col("a").alias("src"), F.col("b").alias("dst"), "w")))


def _heads(c: Contracted) -> DataFrame:
    return c.places.where("place = 0 and not ring").select("graph_id", "node_id")


def _in_one_task(nodes: DataFrame, edges: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """The kernel over what is left of a large graph, TASK_ROWS at most."""
    # new aliases, as both sides may have columns of one table
    one = lambda df: df.select(F.lit(0).alias("task"), *[F.col(c).alias(c) for c in df.columns]).groupBy("task")
    return one(cut(nodes)).cogroup(one(edges)).applyInPandas(kernel, schema)


def _loop_levels(g: TaskGraph) -> DataFrame:
    """Nodes that nothing hangs on are peeled off, as long as they are many, and
    get their levels from their predecessors' in the end; what is left once it
    fits a task is done there, and what does not peel goes by rounds."""
    ids = lambda df, c, flag: df.select("graph_id", F.col(c).alias("node_id"), *[F.lit(x == flag).alias(x) for x in ("node", "out", "into")])
    every = ids(g.nodes, "node_id", "node").unionByName(ids(g.edges, "src", "out")).unionByName(ids(g.edges, "dst", "into"))
    ends = cut(every.groupBy("graph_id", "node_id").agg(*[F.max(c).alias(c) for c in ("node", "out", "into")]))
    found = ends.agg(F.count("*").alias("n"), F.count_if(F.col("out")).alias("core"), F.count_if(~F.col("node")).alias("strays")).first()
    if found["strays"]:
        raise ValueError("an edge names no node")
    if found["core"] > found["n"] * CORE:
        return _round_levels(g)
    core = ends.where("out").select("graph_id", "node_id")
    edges = g.edges.select("graph_id", "src", "dst").join(core.select("graph_id", F.col("node_id").alias("dst"), F.lit(True).alias("inner")), ["graph_id", "dst"], "left")
    edges = cut(edges)
    rest = TaskGraph(core, edges.where("inner").select("graph_id", "src", "dst"))
    rows = found["core"] + rest.edges.count()
    known = grouped(rest, kernels.canonical_orders, ORDERED, rows) if rows <= TASK_ROWS else _loop_levels(rest)
    known = cut(known.select("graph_id", "node_id", "level"))
    leaves = edges.where("inner is null").join(known.withColumnRenamed("node_id", "src"), ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("node_id"))
    leaves = leaves.agg(F.when(F.count("level") == F.count("*"), F.max("level") + 1).alias("level"))
    alone = ends.where("not out and not into").select("graph_id", "node_id", F.lit(0).cast("long").alias("level"))
    return known.unionByName(leaves).unionByName(alone)


def _round_levels(g: TaskGraph) -> DataFrame:
    """Rounds of Kahn's algorithm over chains: chains whose predecessors all
    have levels are the next frontier, and only it, its edges and the chains
    that some of them lead to are written.  Edges that were passed leave now and
    then; what is left once it fits a task is done there."""
    c = _contracted(g)
    edges, into = c.edges, F.col("dst").alias("node_id")
    waits = cut(edges.groupBy("graph_id", into).agg(F.count("*").alias("waits")))
    front = cut(_heads(c).join(waits, ["graph_id", "node_id"], "left_anti").withColumn("level", F.lit(0).cast("long")))
    passed = met = front.limit(0)  # chains whose edges were passed, and those that some of these lead to
    for turn in range(MOST_ROUNDS):
        if turn % SHRINK == 0:
            edges = cut(edges.join(passed.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_anti")) if turn else edges
            if edges.count() <= TASK_ROWS:
                break
        new = edges.join(front.withColumnRenamed("node_id", "src"), ["graph_id", "src"])
        new = new.select("graph_id", into, F.lit(1).cast("long").alias("n"), (F.col("level") + F.col("w")).alias("level"))
        new = new.unionByName(met.select("graph_id", "node_id", "n", "level")) if turn else new
        new = new.groupBy("graph_id", "node_id").agg(F.sum("n").alias("n"), F.max("level").alias("level"))
        new = cut(new.join(waits, ["graph_id", "node_id"]))
        passed = passed.unionByName(front)
        front, met = new.where("n = waits").select("graph_id", "node_id", "level"), new.where("n < waits")
        if front.isEmpty():
            break
    # the rest, from the levels of the frontier and of chains that are met
    base = front.unionByName(met.select("graph_id", "node_id", "level"))
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct().join(base, ["graph_id", "node_id"], "left")
    ends = ends.select("graph_id", "node_id", F.coalesce("level", F.lit(0)).alias("base"))
    rest = front
    if not front.isEmpty():
        rest = cut(_in_one_task(ends, edges, kernels.weighted_levels, "graph_id long, node_id long, level long").where("level is not null"))
        rest = rest.unionByName(front.join(rest, ["graph_id", "node_id"], "left_anti"))
    found = passed.unionByName(rest)
    heads = found.select("graph_id", F.col("node_id").alias("chain_id"), F.col("level").alias("base"))
    whole = c.places.withColumn("chain_id", F.when(~F.col("ring"), F.col("chain_id"))).join(heads, ["graph_id", "chain_id"], "left")
    return whole.select("graph_id", "node_id", (F.col("base") + F.col("place")).cast("long").alias("level"))


def _loop_canonical(g: TaskGraph) -> DataFrame:
    """Places by (level, node_id), numbered over range partitions."""
    known = _loop_levels(g).where("level is not null")
    order = cut(numbered(known, ["graph_id"], ["level", "node_id"], "topo_id"))
    first = order.groupBy("graph_id", "level").agg(F.min("topo_id").alias("before"))
    return order.join(first, ["graph_id", "level"]).select("graph_id", "node_id", "level", (F.col("topo_id") - F.col("before")).alias("lid"), "topo_id")


def _loop_orders(g: TaskGraph) -> DataFrame:
    """FIFO order, level by level: nodes of a level stand by their last
    predecessor's place, then by the place of its edge."""
    levels = cut(_loop_levels(g).join(g.nodes.select("graph_id", "node_id", "node_seq"), ["graph_id", "node_id"]))
    widths = levels.where("level is not null").groupBy("graph_id", "level").agg(F.count("*").alias("w"))
    before = F.coalesce(F.sum("w").over(Window.partitionBy("graph_id").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = cut(widths.select("graph_id", "level", before.alias("base")))
    order = lambda *c: (F.row_number().over(Window.partitionBy("graph_id").orderBy(*c)) - 1).cast("long")
    done = cut(levels.where("level = 0").select("graph_id", "node_id", "level", order("node_seq").alias("lid"), order("node_seq").alias("topo_id")))
    for level in range(1, (levels.agg(F.max("level")).first()[0] or 0) + 1):
        here = levels.where(F.col("level") == level).select("graph_id", F.col("node_id").alias("dst"))
        last = g.edges.join(here, ["graph_id", "dst"]).join(done.select("graph_id", F.col("node_id").alias("src"), "topo_id"), ["graph_id", "src"])
        last = last.groupBy("graph_id", "dst").agg(F.max(F.struct("topo_id", "edge_seq")).alias("m"))
        placed = last.select("graph_id", F.col("dst").alias("node_id"), F.lit(level).cast("long").alias("level"), order("m.topo_id", "m.edge_seq").alias("lid"))
        placed = placed.join(base, ["graph_id", "level"]).select("graph_id", "node_id", "level", "lid", (F.col("base") + F.col("lid")).alias("topo_id"))
        done = cut(done.unionByName(placed))
    return levels.select("graph_id", "node_id").join(done, ["graph_id", "node_id"], "left").select("graph_id", "node_id", "level", "lid", "topo_id")


def levels(g: TaskGraph, strategy: str = "auto", like: TaskGraph | None = None) -> DataFrame:
    """(graph_id, node_id, level): the longest way from any source; null for
    nodes on or behind a cycle."""
    out = by_strategy(g, strategy, kernels.canonical_orders, ORDERED, lambda x: _loop_levels(x).withColumns({"lid": F.lit(None).cast("long"), "topo_id": F.lit(None).cast("long")}), like)
    return out.select("graph_id", "node_id", "level")


def checked_levels(g: TaskGraph, strategy: str = "auto") -> DataFrame:
    """levels, failing on a cycle."""
    stuck = F.raise_error(F.lit("the graph has a cycle")).cast("long")
    return levels(g, strategy).select("graph_id", "node_id", F.when(F.col("level").isNull(), stuck).otherwise(F.col("level")).alias("level"))


def topo_order(g: TaskGraph, order: str = "canonical", strategy: str = "auto") -> DataFrame:
    """(graph_id, node_id, level, lid, topo_id): by (level, node_id), or, "fifo",
    as a queue releases the nodes."""
    if order == "fifo":
        return by_strategy(g, strategy, kernels.level_orders, ORDERED, _loop_orders, listed=True)
    if order != "canonical":
        raise ValueError(f"no such order: {order}")
    return by_strategy(g, strategy, kernels.canonical_orders, ORDERED, _loop_canonical).where("level is not null")


def dfs_order(g: TaskGraph) -> DataFrame:
    """(graph_id, node_id, dfs_id): reverse post-order from the sources.  Each
    step of a depth-first walk hangs on the one before, so a graph is walked in
    one task, and one of more than TASK_ROWS nodes and edges is an error."""
    if is_large(g):
        raise ValueError(f"a depth-first walk over {sizes(g)[1]} nodes and edges is more than a task can hold")
    return grouped(g, kernels.depth_first, "graph_id long, node_id long, dfs_id long", listed=True)


def _loop_reached(g: TaskGraph) -> DataFrame:
    """Breadth-first rounds over chains, by the frontier's edges only; what is
    left once it fits a task is done there."""
    c = _contracted(g)
    edges, into = c.edges, F.col("dst").alias("node_id")
    front = seen = cut(_heads(c).join(edges.select("graph_id", into), ["graph_id", "node_id"], "left_anti"))
    for turn in range(MOST_ROUNDS):
        if turn % SHRINK == 0:
            edges = cut(edges.join(seen.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"], "left_anti")) if turn else edges
            if edges.count() <= TASK_ROWS:
                break
        new = edges.join(front.withColumnRenamed("node_id", "src"), ["graph_id", "src"]).select("graph_id", into).distinct()
        front = cut(new.join(seen, ["graph_id", "node_id"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    if not front.isEmpty():  # no edge leads to what is seen any more: those are the sources of the rest
        ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
        seen = seen.unionByName(_in_one_task(ends, edges, kernels.reached, "graph_id long, node_id long"))
    heads = seen.select("graph_id", F.col("node_id").alias("chain_id"))
    return c.places.where("not ring").join(heads, ["graph_id", "chain_id"], "left_semi").select("graph_id", "node_id")


def unreachable(g: TaskGraph, strategy: str = "auto") -> DataFrame:
    """Nodes that no source reaches."""
    seen = by_strategy(g, strategy, kernels.reached, "graph_id long, node_id long", _loop_reached)
    return g.nodes.join(seen, ["graph_id", "node_id"], "left_anti").select("graph_id", "node_id")


def unreachable_from_sources(g: TaskGraph, strategy: str = "auto") -> DataFrame:
    """(graph_id, has_unreachable): the weak cycle test; a cycle that a source
    leads to is not seen by it."""
    lost = unreachable(g, strategy).select("graph_id").distinct().withColumn("lost", F.lit(True))
    return g.nodes.select("graph_id").distinct().join(lost, "graph_id", "left").select("graph_id", F.coalesce("lost", F.lit(False)).alias("has_unreachable"))


def is_acyclic(g: TaskGraph, strategy: str = "auto") -> DataFrame:
    """(graph_id, acyclic): whether Kahn's rounds reach every node."""
    return levels(g, strategy).groupBy("graph_id").agg((F.count("level") == F.count("*")).alias("acyclic"))


def chain_edges(g: TaskGraph) -> DataFrame:
    """Edges whose source has no other fan-out and whose target no other fan-in."""
    alone = lambda c: g.edges.groupBy("graph_id", c).agg(F.count("*").alias("n")).where("n = 1").drop("n")
    return g.edges.join(alone("src"), ["graph_id", "src"], "left_semi").join(alone("dst"), ["graph_id", "dst"], "left_semi").select("graph_id", "src", "dst")


def _loop_chains(g: TaskGraph) -> DataFrame:
    """Chains as linked lists, contracted by random mates: in each round nodes
    that draw 0 under one that draws 1 leave, about a quarter, and the node
    behind takes over their pointer.  What is left once it fits a task is
    climbed there, and those that left follow, last ones first.  A node is never
    pointed to by more than one, so no join has a hot key."""
    up = chain_edges(g).select("graph_id", F.col("dst").alias("node_id"), F.col("src").alias("up"))
    every = cut(g.nodes.select("graph_id", "node_id").join(up, ["graph_id", "node_id"], "left"))
    lists = every.where("up is not null")
    live = cut(lists.withColumns({"steps": F.lit(1).cast("long"), "low": F.least("node_id", "up")}))
    left = []
    for turn in range(MOST_ROUNDS):
        if live.count() <= TASK_ROWS:
            break
        coin = lambda c: F.pmod(F.xxhash64("graph_id", c, F.lit(turn)), F.lit(2))
        leaves = (coin("node_id") == 0) & (coin("up") == 1)
        gone = cut(live.where(leaves))
        left.append(gone)
        above = gone.select("graph_id", F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("low").alias("low2"))
        stay = live.where(~leaves).join(above, ["graph_id", "up"], "left")
        live = cut(stay.select("graph_id", "node_id", F.coalesce("up2", "up").alias("up"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), F.least("low", "low2").alias("low")))
    shape = "graph_id long, node_id long, chain_id long, place long, ring boolean"
    found = cut(live.withColumn("task", F.lit(0)).groupBy("task").applyInPandas(kernels.list_ends, shape))
    alone = every.where("up is null").select("graph_id", "node_id", F.col("node_id").alias("chain_id"), F.lit(0).cast("long").alias("place"), F.lit(False).alias("ring"))
    found = alone.unionByName(found)
    for gone in left[::-1]:
        above = found.select("graph_id", F.col("node_id").alias("up"), "chain_id", "place", "ring")
        back = gone.join(above, ["graph_id", "up"]).select("graph_id", "node_id", "chain_id", F.when(F.col("ring"), F.lit(0)).otherwise(F.col("place") + F.col("steps")).cast("long").alias("place"), "ring")
        found = found.unionByName(cut(back))
    return found


def chain_places(g: TaskGraph, strategy: str = "auto") -> DataFrame:
    """(graph_id, node_id, chain_id, place, ring): chain_id is the first node of
    the maximal chain and place how far the node is behind it; a chain that is
    a cycle has its smallest node, places of 0 and ring."""
    return by_strategy(g, strategy, kernels.chains, "graph_id long, node_id long, chain_id long, place long, ring boolean", _loop_chains)


def chain_ids(g: TaskGraph, strategy: str = "auto") -> DataFrame:
    """(graph_id, node_id, chain_id) of chain_places."""
    return chain_places(g, strategy).select("graph_id", "node_id", "chain_id")
