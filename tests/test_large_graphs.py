"""The forms of operators for graphs that no task should hold."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dagloom.graph import TaskGraph
from dagloom.operators import cluster, kernels, lanes, schedule, traverse
from dagloom.plans.ranking import numbered, windowed
from tests.test_graphs import random_dag, rows


def tangled(spark, seed=5):
    """Graphs with chains, rings, cycles in the midst, repeated edges, lone
    nodes and ids that say nothing about the order."""
    rng = random.Random(seed)
    nodes, edges = [], []
    for g in range(4):
        ids = rng.sample(range(1000), 60)
        nodes += [(g, v) for v in ids]
        at = 0
        for _ in range(4):  # chains
            size = rng.randrange(1, 9)
            edges += [(g, a, b) for a, b in zip(ids[at : at + size], ids[at + 1 : at + size])]
            at += size
        for _ in range(30):
            a, b = sorted(rng.sample([0, 5, 11, 17, *range(24, 45)], 2))
            edges.append((g, ids[a], ids[b]))
        edges.append(edges[-1])
        if g:  # a ring, and from the second graph on a cycle with ways in and out
            edges += [(g, ids[50 + k], ids[50 + (k + 1) % 4]) for k in range(4)]
        if g > 1:
            edges += [(g, ids[44], ids[46]), (g, ids[46], ids[47]), (g, ids[47], ids[46]), (g, ids[47], ids[48])]
    rng.shuffle(edges)
    return TaskGraph.from_lists(spark, nodes, edges)


@pytest.mark.parametrize("task", [2_000_000, 8])
def test_both_forms_agree(spark, monkeypatch, task):
    """However much of a graph is left to one task."""
    g, dag = tangled(spark), random_dag(spark, seed=9)
    both = lambda f, *c: [sorted(tuple(r[x] for x in c) for r in f(s).collect()) for s in ("grouped", "loop")]
    monkeypatch.setattr(traverse, "SHRINK", 2)
    none = lambda x: -1 if x is None else x
    want = sorted((r.graph_id, r.node_id, none(r.level)) for r in traverse.levels(g, "grouped").collect())
    places = sorted(map(tuple, traverse.chain_places(g, "grouped").collect()))
    assert any(r[4] for r in places) and any(r[3] > 2 for r in places)
    seen = rows(traverse.unreachable(g, "grouped"), "graph_id", "node_id")
    orders = [rows(traverse.topo_order(dag, o, "grouped"), "graph_id", "node_id", "level", "lid", "topo_id") for o in ("canonical", "fifo")]
    monkeypatch.setattr(traverse, "TASK_ROWS", task)
    assert sorted((r.graph_id, r.node_id, none(r.level)) for r in traverse.levels(g, "loop").collect()) == want
    assert sorted(map(tuple, traverse.chain_places(g, "loop").collect())) == places
    assert rows(traverse.unreachable(g, "loop"), "graph_id", "node_id") == seen and seen
    assert [rows(traverse.topo_order(dag, o, "loop"), "graph_id", "node_id", "level", "lid", "topo_id") for o in ("canonical", "fifo")] == orders
    a, b = both(lambda s: traverse.is_acyclic(g, s), "graph_id", "acyclic")
    assert a == b == [(0, True), (1, False), (2, False), (3, False)]


@pytest.mark.parametrize("core", [0, 0.99])
def test_peeled_levels(spark, monkeypatch, core):
    """Leaves are peeled off as long as they are many, or not at all."""
    g = tangled(spark)
    want = sorted(map(str, traverse.levels(g, "grouped").collect()))
    monkeypatch.setattr(traverse, "TASK_ROWS", 8)
    monkeypatch.setattr(traverse, "CORE", core)
    assert sorted(map(str, traverse.levels(g, "loop").collect())) == want


def test_wide_graphs_need_no_chains(spark, monkeypatch):
    """A tree of four levels, most of it leaves: two layers are peeled off."""
    def never(g):
        raise AssertionError("chains were contracted")

    tree = [(0, v) for v in range(1, 6)] + [(1 + v % 5, v) for v in range(6, 56)] + [(6 + v % 40, v) for v in range(56, 800)]
    g = TaskGraph.from_lists(spark, list(range(801)), tree)
    monkeypatch.setattr(traverse, "TASK_ROWS", 30)
    monkeypatch.setattr(traverse, "_loop_chains", never)
    got = {r.node_id: r.level for r in traverse.levels(g).collect()}
    assert got == {0: 0, 800: 0} | {v: 1 if v < 6 else 2 if v < 56 else 3 for v in range(1, 800)}


def test_large_and_small_together(spark, monkeypatch):
    """Each graph goes the way of its own size."""
    g = tangled(spark)
    want = sorted(map(str, traverse.levels(g, "grouped").collect()))
    more = g.edges.where("graph_id = 2")
    monkeypatch.setattr(traverse, "TASK_ROWS", 60 + more.count() - 1)
    assert sorted(map(str, traverse.levels(g).collect())) == want


def test_lanes_of_large_graphs(spark):
    """Numbered over range partitions as by windows."""
    g = random_dag(spark, seed=6)
    for order in ("canonical", "fifo"):
        laned = lanes.lanes(g, 3, order)
        ends = lambda df: rows(df, "graph_id", "src", "dst")
        assert ends(lanes.lane_chains(laned, large=True)) == ends(lanes.lane_chains(laned))
        assert ends(lanes.cross_edges(g, laned, large=True)) == ends(lanes.cross_edges(g, laned))
        assert ends(lanes.lane_graph(g, laned, "loop").edges) == ends(lanes.lane_graph(g, laned).edges)
    for more in (False, True):
        laned = lanes.lanes(g, 3)
        limited = lanes.lane_constraints(g, laned) if more else lanes.lane_graph(g, laned)
        assert ends(lanes.limited_edges(g, 3, more)) == ends(limited.edges)
        a, b = rows(schedule.run_lanes(g, 3, more), "graph_id", "node_id", "wave", "slot"), rows(schedule.schedule_lanes(g, laned, more), "graph_id", "node_id", "wave", "slot")
        assert a == b and len(a) == 90
    found = [rows(cluster.convex_clusters(g, 4, s), "graph_id", "node_id", "cluster_id") for s in ("grouped", "loop")]
    assert found[0] == found[1]


def line(spark, n, step):
    """One chain of n nodes, ids in no order of their places."""
    at = lambda c: F.pmod(F.col(c) * step, F.lit(n))
    nodes = spark.range(n).select(F.lit(0).cast("long").alias("graph_id"), F.col("id").alias("node_id"))
    edges = spark.range(n - 1).select(F.lit(0).cast("long").alias("graph_id"), F.col("id").alias("edge_seq"), at("id").alias("src"), F.pmod((F.col("id") + 1) * step, F.lit(n)).alias("dst"))
    return TaskGraph(nodes.withColumns({"name": F.lit(""), "node_seq": F.col("node_id")}), edges)


def test_chain_of_a_million_nodes(spark, monkeypatch):
    """Levels in a few rounds, whatever the depth."""
    n, step = 1_000_000, 7
    began = time.monotonic()
    found = traverse.levels(line(spark, n, step), "loop")
    wrong = found.where(F.col("node_id") != F.pmod(F.col("level") * step, F.lit(n)))
    assert found.count() == n and wrong.isEmpty()
    assert time.monotonic() - began < 120


def test_list_ranking_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(traverse, "TASK_ROWS", 3_000)
    n, step = 20_000, 3
    ring = line(spark, n, step)
    back = spark.range(1).select(F.lit(0).cast("long").alias("graph_id"), F.lit(n).cast("long").alias("edge_seq"), F.lit((n - 1) * step % n).cast("long").alias("src"), F.lit(0).cast("long").alias("dst"))
    found = traverse.chain_places(line(spark, n, step), "loop")
    assert found.where("chain_id <> 0 or ring").isEmpty() and found.count() == n
    assert found.where(F.col("node_id") != F.pmod(F.col("place") * step, F.lit(n))).isEmpty()
    found = traverse.chain_places(TaskGraph(ring.nodes, ring.edges.unionByName(back)), "loop")
    assert found.where("chain_id <> 0 or place <> 0 or not ring").isEmpty() and found.count() == n


def test_deep_reachability(spark):
    began = time.monotonic()
    assert traverse.unreachable(line(spark, 10_000, 3), "loop").isEmpty()
    assert time.monotonic() - began < 60


@pytest.mark.parametrize("strategy", ["grouped", "loop"])
def test_unknown_ends(spark, strategy):
    g = TaskGraph.from_lists(spark, [0, 1], [(0, 1), (1, 5)])
    for f in (traverse.levels, traverse.unreachable, lambda x, s: traverse.topo_order(x, "fifo", s)):
        with pytest.raises(Exception, match="an edge names no node"):
            f(g, strategy).collect()


def test_walks_are_for_graphs_that_fit(spark, monkeypatch):
    monkeypatch.setattr(traverse, "TASK_ROWS", 30)
    with pytest.raises(ValueError, match="depth-first"):
        traverse.dfs_order(random_dag(spark))


def test_numbers_within_groups(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(0 if rng.random() < 0.7 else rng.randrange(50), i, rng.random()) for i in range(5000)], "g long, i long, x double").repartition(5)
    a, b = (sorted(map(tuple, f(df, ["g"], ["x", "i"], "n").collect())) for f in (windowed, numbered))
    assert a == b
    assert numbered(df.limit(0), ["g"], ["i"], "n").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.lists(st.tuples(st.integers(0, 1), st.integers(0, 14), st.integers(0, 14)), max_size=50))
def test_clusters_node_by_node(size, pairs):
    """Levels at once against a walk in (level, node_id) order."""
    edges = pd.DataFrame([(g, min(a, b), max(a, b)) for g, a, b in pairs if a != b], columns=["graph_id", "src", "dst"], dtype=np.int64)
    nodes = pd.DataFrame([(g, v) for g in (0, 1) for v in range(15 - 5 * g)], columns=["graph_id", "node_id"])
    edges = edges[(edges["graph_id"] == 0) | (edges["dst"] < 10)]
    got = {(r.graph_id, r.node_id): r.cluster_id for r in kernels.convex_clusters(nodes, edges, size).itertuples()}
    for g in (0, 1):
        before = {v: [r.src for r in edges.itertuples() if r.graph_id == g and r.dst == v] for v in range(15 - 5 * g)}
        level, at, held = {}, {}, []
        for v in before:  # edges rise
            level[v] = max([level[p] + 1 for p in before[v]], default=0)
        for v in sorted(before, key=lambda v: (level[v], v)):
            want = max([at[p] for p in before[v]], default=len(held))
            if want == len(held) or held[want] >= size:
                want = len(held)
                held.append(0)
            held[want] += 1
            at[v] = want
        assert {v: got[g, v] for v in before} == at


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 60), st.randoms())
def test_climbing(n, rng):
    """Against a walk from each node."""
    order = list(range(n))
    rng.shuffle(order)
    up = [-1] * n
    at = 0
    while at < n:
        size = rng.randrange(1, n - at + 1)
        part = order[at : at + size]
        for a, b in zip(part, part[1:]):
            up[b] = a
        if size > 1 and rng.random() < 0.3:
            up[part[0]] = part[-1]
        at += size
    head, steps, low, ring = kernels._climbed(np.array(up), np.ones(n, np.int64), np.arange(n))
    for v in range(n):
        path = [v]
        while up[path[-1]] >= 0 and up[path[-1]] not in path:
            path.append(up[path[-1]])
        assert bool(ring[v]) == (up[path[-1]] >= 0)
        if ring[v]:
            assert low[v] == min(path)
        else:
            assert (head[v], steps[v]) == (path[-1], len(path) - 1)
