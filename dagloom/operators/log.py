"""Logs of changes to graphs.

Rows of a log (``LOG``) take effect in the order of (iter, step), which must
tell a graph's rows apart:

* add_node (node_id, name): nothing if the node is there; else it goes to the
  end of the list;
* remove_node (node_id): its edges go with it; nothing if it is not there;
* add_edge (src, dst): nothing unless both ends are there;
* remove_edge (edge_seq): that edge, if it is there.

Added nodes and edges are numbered on from the graph's largest node_seq and
edge_seq; each such row takes a number, whether or not it does anything.

``changes`` folds a log to what can matter, without looking at the graph, and
``fold`` applies that to a graph.  Streaming makes the same changes with keyed
state (``dagloom.streaming.mutations``), so the graph is the same however the
log is cut into batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dagloom.graph import TaskGraph
from dagloom.operators.traverse import TASK_ROWS
from dagloom.plans.ranking import ranked

LOG = "graph_id long, iter long, step long, op string, node_id long, edge_seq long, src long, dst long, name string"
#: number: of add_node and add_edge rows among those of their graph; src_there
#: and dst_there: whether the log itself put the end there (else it is there if
#: the graph had it at first).
CHANGES = LOG + ", number long, src_there boolean, dst_there boolean"


def _time() -> Column:
    return F.struct("iter", "step").alias("t")


def changes(log: DataFrame) -> DataFrame:
    """CHANGES of a log.  An added edge whose end was removed before, and not
    added again, is left out."""
    log = log.select(*[c.split()[0] for c in LOG.split(", ")])
    # op as a literal, so that who filters by it leaves out the other parts
    of = lambda op, df: df.withColumn("op", F.lit(op))
    number = lambda op: of(op, ranked(log.where(F.col("op") == op), ["graph_id"], ["iter", "step"], "number", TASK_ROWS))
    nodes = number("add_node").unionByName(of("remove_node", log.where("op = 'remove_node'")), allowMissingColumns=True)
    edges = number("add_edge")
    # what was last done to each end before the edge came
    ends = edges.select("graph_id", "iter", "step", F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.lit("src").alias("end")), F.struct(F.col("dst").alias("node_id"), F.lit("dst").alias("end")))).alias("x"))
    done = nodes.select("graph_id", "node_id", "iter", "step", "op", F.lit(None).cast("string").alias("end"))
    both = done.unionByName(ends.select("graph_id", "x.node_id", "iter", "step", F.lit(None).cast("string").alias("op"), "x.end"))
    last = F.last("op", ignorenulls=True).over(Window.partitionBy("graph_id", "node_id").orderBy("iter", "step").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("last", last).where("end is not null").groupBy("graph_id", "iter", "step")
    at = lambda c: F.max(F.when(F.col("end") == c, F.coalesce("last", F.lit("")))).alias(f"{c}_last")
    edges = edges.join(found.agg(at("src"), at("dst")), ["graph_id", "iter", "step"]).where("src_last <> 'remove_node' and dst_last <> 'remove_node'")
    edges = edges.withColumns({"src_there": F.col("src_last") == "add_node", "dst_there": F.col("dst_last") == "add_node"}).drop("src_last", "dst_last")
    rest = nodes.unionByName(of("remove_edge", log.where("op = 'remove_edge'")), allowMissingColumns=True)
    return edges.unionByName(rest, allowMissingColumns=True)


def fold(g: TaskGraph, found: DataFrame) -> TaskGraph:
    """The graph after the changes (CHANGES)."""
    of = lambda op: found.where(F.col("op") == op)
    gone = of("remove_node").groupBy("graph_id", "node_id").agg(F.max(_time()).alias("gone"))
    next_of = lambda df, c: df.groupBy("graph_id").agg((F.max(c) + 1).alias("next"))

    added = of("add_node").withColumn("t", _time()).join(gone, ["graph_id", "node_id"], "left").where("gone is null or t > gone")
    added = added.groupBy("graph_id", "node_id", "gone").agg(F.min(F.struct("t", "name", "number")).alias("first"))
    old = g.nodes.join(gone, ["graph_id", "node_id"], "left_anti")
    here = g.nodes.select("graph_id", "node_id", F.lit(True).alias("here"))
    added = added.join(here, ["graph_id", "node_id"], "left").where("gone is not null or here is null")
    added = added.join(next_of(g.nodes, "node_seq"), "graph_id", "left")
    added = added.select("graph_id", "node_id", "first.name", (F.coalesce("next", F.lit(0)) + F.col("first.number")).alias("node_seq"))
    nodes = old.select("graph_id", "node_id", "name", "node_seq").unionByName(added)

    ends = of("add_edge").withColumn("t", _time())
    for c in ("src", "dst"):
        ends = ends.join(here.toDF("graph_id", c, f"{c}_here"), ["graph_id", c], "left").where(F.col(f"{c}_there") | F.col(f"{c}_here"))
    ends = ends.join(next_of(g.edges, "edge_seq"), "graph_id", "left")
    ends = ends.select("graph_id", (F.coalesce("next", F.lit(0)) + F.col("number")).alias("edge_seq"), "src", "dst", "t")
    first = g.edges.select("graph_id", "edge_seq", "src", "dst", F.lit(None).cast(dict(ends.dtypes)["t"]).alias("t"))
    edges = first.unionByName(ends)
    cut = of("remove_edge").groupBy("graph_id", "edge_seq").agg(F.max(_time()).alias("gone"))
    later = "gone is null or t > gone"  # what was there at first has no time
    edges = edges.join(cut, ["graph_id", "edge_seq"], "left").where(later).drop("gone")
    for c in ("src", "dst"):
        edges = edges.join(gone.toDF("graph_id", c, "gone"), ["graph_id", c], "left").where(later).drop("gone")
    return TaskGraph(nodes, edges.select("graph_id", "edge_seq", "src", "dst"))


def apply_log(g: TaskGraph, log: DataFrame) -> TaskGraph:
    return fold(g, changes(log))
