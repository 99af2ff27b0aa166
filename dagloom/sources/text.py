"""Graph text files, DOT text and CSV result files.

A graph file's first line is its number of nodes; lines ``"name";`` follow for
nodes and ``"a" -> "b";`` for edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dagloom.graph import TaskGraph
from dagloom.operators.traverse import TASK_ROWS
from dagloom.plans.fixpoint import cut
from dagloom.plans.ranking import ranked

_NODE = r'^\s*"([^"]*)"\s*;\s*$'
_EDGE = r'^\s*"([^"]*)"\s*->\s*"([^"]*)"\s*;\s*$'


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(graph, line, text) of text files.  Files are read in parallel, large
    ones in blocks; a line's number is its place in its block and the lines of
    the blocks before.  A file is a graph, and so is a folder ``graph_id=..`` of
    files, whose lines go on from file to file in the order of their names."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    lines = cut(raw.withColumn("id", F.monotonically_increasing_id()))
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    folder = F.regexp_extract("file", r"^(.*/graph_id=[^/]*)/[^/]*$", 1)
    blocks = blocks.withColumn("graph", F.when(folder != "", folder).otherwise(F.col("file")))
    before = F.sum("n").over(Window.partitionBy("graph").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", "graph", (F.coalesce(before, F.lit(0)) - F.col("low")).alias("shift"))
    return lines.join(blocks, ["file", "block"]).select("graph", (F.col("shift") + F.col("id")).alias("line"), F.rtrim(F.col("value")).alias("text"))


def read_graph(spark: SparkSession, path: str | list[str]) -> TaskGraph:
    """One graph for each file (or folder ``graph_id=..`` of files), numbered by
    path.  Of nodes that share a name, the last is meant by edges.  Reading
    fails where an edge names no node or the first line gives another number of
    nodes."""
    lines = numbered_lines(spark, path)
    lines = lines.withColumns({"name": F.regexp_extract("text", _NODE, 1), "a": F.regexp_extract("text", _EDGE, 1), "b": F.regexp_extract("text", _EDGE, 2),
                               "is_node": F.col("text").rlike(_NODE), "is_edge": F.col("text").rlike(_EDGE)})
    lines = cut(lines.where("line = 0 or is_node or is_edge"))
    numbers = lines.where("line = 0").select("graph", "text").withColumn("graph_id", (F.row_number().over(Window.orderBy("graph")) - 1).cast("long"))
    stated = numbers.select("graph_id", F.trim("text").try_cast("long").alias("stated"))
    lines = lines.join(numbers.select("graph", "graph_id"), "graph")
    placed = lambda kind, into, *c: ranked(lines.where(kind).select("graph_id", "line", *c), ["graph_id"], ["line"], into, TASK_ROWS).drop("line")
    nodes = placed("is_node", "node_seq", "name")
    counted = stated.join(nodes.groupBy("graph_id").agg(F.count("*").alias("n")), "graph_id", "left")
    wrong = F.coalesce("n", F.lit(0)) != F.coalesce("stated", F.lit(-1))
    checked = counted.select("graph_id", F.when(wrong, F.raise_error(F.concat(F.lit("the node count is not as stated in graph "), F.col("graph_id").cast("string")))).otherwise(F.lit(True)).alias("fine"))
    nodes = nodes.join(checked, "graph_id").where("fine").select("graph_id", F.col("node_seq").alias("node_id"), "name", "node_seq")
    edges = placed("is_edge", "edge_seq", "a", "b")
    last = nodes.groupBy("graph_id", "name").agg(F.max("node_id").alias("id"))
    edges = edges.join(last.select("graph_id", F.col("name").alias("a"), F.col("id").alias("src")), ["graph_id", "a"], "left")
    edges = edges.join(last.select("graph_id", F.col("name").alias("b"), F.col("id").alias("dst")), ["graph_id", "b"], "left")
    known = lambda c, n: F.when(F.col(c).isNull(), F.raise_error(F.concat(F.lit("no such node: "), F.col(n))).cast("long")).otherwise(F.col(c)).alias(c)
    return TaskGraph(nodes, edges.select("graph_id", "edge_seq", known("src", "a"), known("dst", "b")))


def dot_lines(g: TaskGraph) -> DataFrame:
    """(graph_id, line_no, line): a digraph with its nodes, then its edges."""
    a = g.nodes.select("graph_id", F.col("node_id").alias("src"), F.col("name").alias("a"))
    b = g.nodes.select("graph_id", F.col("node_id").alias("dst"), F.col("name").alias("b"))
    edges = g.edges.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"])
    size = g.nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    out = g.nodes.select("graph_id", (F.col("node_seq") + 1).alias("line_no"), F.concat(F.lit('"'), "name", F.lit('";')).alias("line"))
    arrows = edges.join(size, "graph_id").select("graph_id", (F.col("n") + 1 + F.col("edge_seq")).alias("line_no"), F.concat(F.lit('"'), "a", F.lit('" -> "'), "b", F.lit('";')).alias("line"))
    many = size.join(g.edges.groupBy("graph_id").agg(F.max("edge_seq").alias("m")), "graph_id", "left")
    ends = many.select("graph_id", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("line_no"), F.lit("digraph {").alias("line")),
                                                     F.struct((F.col("n") + 2 + F.coalesce("m", F.lit(-1))).alias("line_no"), F.lit("}").alias("line")))).alias("x"))
    return out.union(arrows).union(ends.select("graph_id", "x.line_no", "x.line"))


def _write_lines(lines: DataFrame, path: str) -> None:
    """A folder ``graph_id=..`` for each graph.  Lines are range-partitioned, so
    a large graph is written by many tasks, to files whose names go by line."""
    ordered = lines.repartitionByRange("graph_id", "line_no").sortWithinPartitions("graph_id", "line_no")
    ordered.select("graph_id", F.col("line").alias("value")).write.partitionBy("graph_id").text(path)


def write_dot(g: TaskGraph, path: str) -> None:
    """A folder of text for each graph."""
    _write_lines(dot_lines(g), path)


def write_graph(g: TaskGraph, path: str) -> None:
    """The folders that read_graph reads; names must hold no quotes.  A folder's
    files, one after the other, are the text of its graph."""
    size = g.nodes.groupBy("graph_id").agg(F.count("*").alias("n")).select("graph_id", F.lit(0).cast("long").alias("line_no"), F.col("n").cast("string").alias("line"))
    _write_lines(size.union(dot_lines(g).where("line not in ('digraph {', '}')")), path)


def append_results(results: DataFrame, path: str) -> None:
    """Adds rows to a CSV result folder.  The first call writes the header, as a
    folder of its own that comes before all others; those of one call are named
    by their number.  The files, one after the other, are one CSV text."""
    spark = results.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    calls = sorted(int(n[5:]) for n in found if n.startswith("call=") and n[5:].isdigit())
    if not calls:
        spark.createDataFrame([tuple(results.columns)], ", ".join(f"`{c}` string" for c in results.columns)).coalesce(1).write.csv(f"{path}/call=000000")
    results.write.csv(f"{path}/call={(calls or [0])[-1] + 1:06d}")


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all calls of append_results."""
    every = spark.read.option("basePath", path).schema(f"{schema}, call string").csv(f"{path}/call=*")
    return every.where("call <> '000000'").drop("call")


def harness_averages(log: DataFrame) -> DataFrame:
    """log: (benchmark, run, line_no, line), lines such as ``run time: 123 us``.
    A run's last line of a metric counts; the mean over the benchmark's runs has
    six decimals, cut off.  A metric that a run lacks has no mean."""
    metric = F.regexp_extract("line", r"^\s*([A-Za-z_ ]+?)\s*[:=]\s*(\d+)\s*(?:us|ms)?\s*$", 1)
    value = F.regexp_extract("line", r"^\s*([A-Za-z_ ]+?)\s*[:=]\s*(\d+)\s*(?:us|ms)?\s*$", 2)
    runs = log.groupBy("benchmark").agg(F.count_distinct("run").alias("runs"))
    rows = log.select("benchmark", "run", "line_no", metric.alias("metric"), value.try_cast("long").alias("value")).where("value is not null")
    last = rows.groupBy("benchmark", "metric", "run").agg(F.max_by("value", "line_no").alias("value"))
    sums = last.groupBy("benchmark", "metric").agg(F.sum("value").alias("total"), F.count("*").alias("n")).join(runs, "benchmark")
    mean = F.expr("(total * 1000000L) div runs") / F.lit(1e6)
    return sums.select("benchmark", "metric", F.when(F.col("n") == F.col("runs"), mean).alias("average"))
