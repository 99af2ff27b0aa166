"""Logs of changes: against a plain walk, and as streams cut at any place."""

import random

import pytest
from pyspark.sql import functions as F

from dagloom.graph import TaskGraph
from dagloom.operators import log as logs
from dagloom.operators.log import LOG
from dagloom.sources import tables
from dagloom.streaming import mutations
from tests.test_graphs import random_dag


def a_log(seed=1, graphs=3, rows=150):
    """Nodes come and go again and again; some rows do nothing."""
    rng = random.Random(seed)
    out = []
    for t in range(rows):
        g, node = rng.randrange(graphs), lambda: rng.randrange(36)
        op = rng.choice(["add_node", "remove_node", "add_edge", "add_edge", "remove_edge"])
        is_edge = op == "add_edge"
        out.append((g, t // 10, t % 10, op, node() if op.endswith("node") else None, rng.randrange(90) if op == "remove_edge" else None,
                    node() if is_edge else None, node() if is_edge else None, f"n{t}" if op == "add_node" else None))
    return out


def walk(nodes, edges, log):
    """Rows of nodes (graph, id, name, seq) and edges (graph, seq, src, dst)."""
    nodes, edges = {(g, v): (name, seq) for g, v, name, seq in nodes}, {(g, e): (a, b) for g, e, a, b in edges}
    next_node, next_edge = {}, {}
    for g, *_ in log:
        next_node[g] = max([seq + 1 for (x, _), (_, seq) in nodes.items() if x == g], default=0)
        next_edge[g] = max([e + 1 for x, e in edges if x == g], default=0)
    for g, _, _, op, node, edge, src, dst, name in sorted(log, key=lambda r: r[1:3]):
        if op == "add_node":
            nodes.setdefault((g, node), (name, next_node[g]))
            next_node[g] += 1
        elif op == "remove_node":
            nodes.pop((g, node), None)
            edges = {k: ab for k, ab in edges.items() if k[0] != g or node not in ab}
        elif op == "add_edge":
            if (g, src) in nodes and (g, dst) in nodes:
                edges[g, next_edge[g]] = (src, dst)
            next_edge[g] += 1
        else:
            edges.pop((g, edge), None)
    return sorted((*k, *x) for k, x in nodes.items()), sorted((*k, *x) for k, x in edges.items())


def rows_of(g):
    order = lambda df, *c: sorted(tuple(r[x] for x in c) for r in df.collect())
    return order(g.nodes, "graph_id", "node_id", "name", "node_seq"), order(g.edges, "graph_id", "edge_seq", "src", "dst")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_log(spark, seed):
    g, log = random_dag(spark, seed=seed), a_log(seed)
    want = walk(*rows_of(g), log)
    random.Random(seed).shuffle(log)
    assert rows_of(logs.apply_log(g, spark.createDataFrame(log, LOG))) == want
    assert want != rows_of(g)


def test_order_decides(spark):
    """A node that comes and goes: the last row wins, in one batch as in two."""
    g = TaskGraph.from_lists(spark, [0, 1], [(0, 1)])
    add, remove = (0, 0, 0, "add_node", 5, None, None, None, "five"), (0, 1, 0, "remove_node", 5, None, None, None, None)
    one = lambda *rows: spark.createDataFrame(list(rows), LOG)
    assert logs.apply_log(g, one(add, remove)).nodes.where("node_id = 5").isEmpty()
    assert logs.apply_log(logs.apply_log(g, one(add)), one(remove)).nodes.where("node_id = 5").isEmpty()
    assert rows_of(logs.apply_log(TaskGraph.empty(spark), one(add))) == ([(0, 5, "five", 0)], [])
    assert rows_of(logs.apply_log(g, one(add).limit(0))) == rows_of(g)


def files(spark, rows, parts, path):
    """The log in files of neighbouring rows, named in order."""
    edges = [round(i * len(rows) / parts) for i in range(parts + 1)]
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        spark.createDataFrame(rows[a:b], LOG).coalesce(1).write.mode("append").parquet(f"{path}/part={i:03d}")


@pytest.mark.parametrize("parts", [1, 6])
def test_streams_give_the_same(spark, tmp_path, parts):
    g, log = random_dag(spark, seed=4), a_log(4)
    files(spark, log, parts, str(tmp_path / "log"))
    for k in range(parts):  # a run for each file, so that each is a batch
        stream = spark.readStream.schema(LOG).parquet(f"{tmp_path}/log/part={'[0-9]' * 3}") if parts == 1 else None
        if stream is None:
            spark.read.schema(LOG).parquet(f"{tmp_path}/log/part={k:03d}").coalesce(1).write.mode("append").parquet(str(tmp_path / "arrived"))
            stream = spark.readStream.schema(LOG).parquet(str(tmp_path / "arrived"))
        query = mutations.run(stream, str(tmp_path / "changes"), str(tmp_path / "check"))
        assert query.awaitTermination(180)
    assert rows_of(mutations.saved(spark, str(tmp_path / "changes"), g)) == walk(*rows_of(g), log)


def test_rows_that_come_too_late(spark, tmp_path):
    late = [(0, 3, 0, "add_node", 5, None, None, None, "a"), (0, 2, 0, "remove_node", 5, None, None, None, None)]
    for row in late:
        spark.createDataFrame([row], LOG).write.mode("append").parquet(str(tmp_path / "log"))
        query = mutations.run(spark.readStream.schema(LOG).parquet(str(tmp_path / "log")), str(tmp_path / "changes"), str(tmp_path / "check"))
        if row is late[0]:
            assert query.awaitTermination(180)
        else:
            with pytest.raises(Exception, match="comes after a later one"):
                query.awaitTermination(180)


def test_hours_are_dealt_by_rows(spark, monkeypatch):
    """A task's share of the events is bounded by rows, whatever small
    partitions would be joined to; each hour stays whole."""
    monkeypatch.setattr(tables, "HOUR_ROWS", 50)
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    log = tables.event_log(spark, "/root/testdata/sf0.001").select("graph_id", F.spark_partition_id().alias("part"))
    parts = log.distinct().collect()
    assert len({r.part for r in parts}) > events.count() // 100
    assert len(parts) == len({r.graph_id for r in parts})


def test_nodes_need_no_edges(spark):
    """Whoever filters changes by op leaves out what other rows would cost."""
    log = spark.createDataFrame(a_log(), LOG)
    plan = lambda op: logs.changes(log).where(F.col("op") == op)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan("remove_node") and "Window" not in plan("remove_node")
    assert "Join" in plan("add_edge")
