"""Graphs over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dagloom.graph import Hypergraph, TaskGraph, UndirectedGraph

#: Rows of lineitem that a partition of part_orders is meant to have.
PART_ROWS = 250_000
#: Events that a task over hours is meant to have.  Sorts by hour stand on each
#: other in one stage, at about a kilobyte an event, and partitions of a number
#: that is given aren't joined to larger ones by their compressed sizes.
HOUR_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hour_of(df: DataFrame, c: str) -> Column:
    """Whole hours since the epoch, whatever the session's time zone."""
    if dict(df.dtypes)[c] == "timestamp_ntz":
        return (F.unix_date(F.to_date(c)).cast("long") * 24 + F.hour(c)).cast("long")
    return F.floor(F.unix_seconds(c) / 3600).cast("long")


def by_hour(events: DataFrame, *more: Column | str) -> DataFrame:
    """Events with graph_id, their hour; whole hours to a partition."""
    rows = events.select(hour_of(events, "ts").alias("graph_id"), *more)
    return rows.repartition(events.count() // HOUR_ROWS + 1, "graph_id")


def event_graph(spark: SparkSession, sf_dir: str) -> TaskGraph:
    """A graph for each hour: an event precedes the same user's next event and
    the next event of its type."""
    events = table(spark, sf_dir, "events")
    keyed = by_hour(events, F.col("event_id").alias("node_id"), "ts", "user_id", "event_type")
    after = lambda c: F.lead("node_id").over(Window.partitionBy("graph_id", c).orderBy("ts", "node_id"))
    ahead = keyed.select("graph_id", F.col("node_id").alias("src"), after("user_id").alias("by_user"), after("event_type").alias("by_type"))
    follows = ahead.select("graph_id", "src", F.explode(F.array("by_user", "by_type")).alias("dst"))
    return TaskGraph.of(keyed.select("graph_id", "node_id"), follows.where("dst is not null").distinct())


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of changes to the hours' graphs, a row for each event: a click
    removes the first of its block of four events of the hour and a signup adds
    it (again); a view leads from that one to the event; a purchase adds a node
    of the event's negative id; an error removes the edge of the event's rank.
    Rows go by tens of minutes and event."""
    events = table(spark, sf_dir, "events")
    rows = by_hour(events, F.floor(F.minute("ts") / 10).cast("long").alias("iter"), F.col("event_id").cast("long").alias("step"), F.col("event_type").alias("type"))
    rows = rows.withColumn("rank", (F.row_number().over(Window.partitionBy("graph_id").orderBy("step")) - 1).cast("long"))
    head = F.min("step").over(Window.partitionBy("graph_id", F.floor(F.col("rank") / 4)))
    rows = rows.withColumn("head", head)
    is_ = lambda *types: F.col("type").isin(*types)
    op = F.when(is_("click"), "remove_node").when(is_("signup", "purchase"), "add_node").when(is_("view"), "add_edge").otherwise("remove_edge")
    return rows.select(
        "graph_id", "iter", "step", op.alias("op"),
        F.when(is_("click", "signup"), F.col("head")).when(is_("purchase"), -F.col("step")).alias("node_id"),
        F.when(op == "remove_edge", F.col("rank")).alias("edge_seq"),
        F.when(op == "add_edge", F.col("head")).alias("src"), F.when(op == "add_edge", F.col("step")).alias("dst"),
        F.when(op == "add_node", F.concat_ws("_", "type", "step")).alias("name"),
    )


def conversation_graph(spark: SparkSession, sf_dir: str, planted: bool = False) -> TaskGraph:
    """A chain of turns for each conversation.  planted: of conversations with
    three turns or more, every third gets an edge from its last turn to its
    second, and the next to its first."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("graph_id"), F.col("turn").cast("long").alias("node_id")).distinct()
    by = Window.partitionBy("graph_id").orderBy("node_id")
    edges = turns.select("graph_id", F.col("node_id").alias("src"), F.lead("node_id").over(by).alias("dst")).where("dst is not null")
    if planted:
        ends = turns.groupBy("graph_id").agg(F.array_sort(F.collect_list("node_id")).alias("t")).where(F.size("t") >= 3)
        kind = F.pmod("graph_id", F.lit(3))
        back = ends.where(kind < 2).select("graph_id", F.element_at("t", -1).alias("src"), F.element_at("t", F.when(kind == 0, 2).otherwise(1)).alias("dst"))
        edges = edges.union(back)
    return TaskGraph.of(turns, edges)


def key_graph(spark: SparkSession, sf_dir: str) -> TaskGraph:
    """One wide, shallow graph: region, nation, customer, order by foreign key.
    Node ids are 10 * key + kind."""
    region, nation, customer, orders = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    node = lambda c, kind: (F.col(c).cast("long") * 10 + kind)
    keys = [(region, "r_regionkey"), (nation, "n_nationkey"), (customer, "c_custkey"), (orders, "o_orderkey")]
    up = [(nation, "n_regionkey"), (customer, "c_nationkey"), (orders, "o_custkey")]
    nodes = None
    for kind, (df, key) in enumerate(keys):
        part = df.select(F.lit(0).cast("long").alias("graph_id"), node(key, kind).alias("node_id"))
        nodes = part if nodes is None else nodes.union(part)
    edges = None
    for kind, ((df, parent), (_, key)) in enumerate(zip(up, keys[1:])):
        part = df.select(F.lit(0).cast("long").alias("graph_id"), node(parent, kind).alias("src"), node(key, kind + 1).alias("dst"))
        edges = part if edges is None else edges.union(part)
    return TaskGraph.of(nodes, edges)


def part_graph(spark: SparkSession, sf_dir: str) -> UndirectedGraph:
    """Parts that occur in one order."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    other = items.select("l_orderkey", F.col("l_partkey").alias("dst"))
    pairs = items.join(other, "l_orderkey").select(F.col("l_partkey").alias("src"), "dst").where("src < dst").distinct()
    return UndirectedGraph.of(items.select(F.col("l_partkey").alias("v")), pairs)


def part_orders(spark: SparkSession, sf_dir: str) -> Hypergraph:
    """The same neighbours, with orders as hyperedges of their parts.  Rows of an
    order are next to each other, so that a task's sums by order are few."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("e"), F.col("l_partkey").alias("v"))
    items = items.repartitionByRange(items.count() // PART_ROWS + 1, "e", "v").distinct().sortWithinPartitions("e", "v")
    return Hypergraph(items.select("v").distinct(), items)
