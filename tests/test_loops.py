"""Loops of runs and changes, and large ids."""

import pytest
from pyspark.sql import functions as F

from dagloom.functions.numbers import priority
from dagloom.graph import TaskGraph
from dagloom.operators import lanes, mis, mutate, schedule, traverse
from tests.test_graphs import random_dag


@pytest.mark.parametrize("mode", ["semaphore", "lanes", "lanes-incremental"])
def test_incremental_runs(spark, mode):
    """Each turn runs the graph as it was before its change, with the bounced k."""
    g = random_dag(spark, graphs=2, n=12)
    got = {(r.iter, r.graph_id): r for r in schedule.incremental_runs(g, mode, 3, 2, most=2, seed=7).collect()}
    changes = mutate.incremental(g, 3, 2, 7)
    for turn, k in enumerate([2, 1, 2]):
        nodes = [(r.graph_id, r.node_id) for r in g.nodes.collect()]
        edges = {(r.graph_id, r.src, r.dst) for r in g.edges.collect()}
        if mode != "semaphore":
            laned = lanes.lanes(g, k)
            limited = lanes.lane_graph(g, laned) if mode == "lanes" else lanes.lane_constraints(g, laned)
            edges = {(r.graph_id, r.src, r.dst) for r in limited.edges.collect()}
        _, g, _ = next(changes)
        for graph in (0, 1):
            level = {v: 0 for x, v in nodes if x == graph}
            for _ in level:
                for x, a, b in edges:
                    if x == graph:
                        level[b] = max(level[b], level[a] + 1)
            width = [list(level.values()).count(x) for x in range(max(level.values()) + 1)]
            r = got[turn, graph]
            assert (r.k, r.tasks, r.total) == (k, len(level), len(level) * 1024)
            if mode == "semaphore":
                assert r.waves == sum(-(-w // k) for w in width) and r.widest <= k
            else:
                assert r.waves == len(width) and r.widest == max(width) <= k
            assert r.nodes == g.nodes.where(F.col("graph_id") == graph).count()


def test_unknown_mode_and_cycles(spark):
    with pytest.raises(ValueError):
        schedule.incremental_runs(random_dag(spark), "none", 1, 1)
    ring = TaskGraph.from_lists(spark, [0, 1, 2], [(0, 1), (1, 2), (2, 1)])
    for strategy in ("grouped", "loop"):
        with pytest.raises(Exception, match="cycle"):
            schedule.incremental_runs(ring, "semaphore", 1, 0, strategy=strategy).collect()
        found = mutate.incremental_stats(ring, 1, 0, strategy=strategy).collect()
        assert [(r.nodes, r.edges, r.acyclic) for r in found] == [(3, 3, False)]


def test_large_ids(spark):
    big = 10**15
    g = TaskGraph.from_lists(spark, [big + v for v in range(6)], [(big + v, big + v + 1) for v in range(5)])
    assert mutate.remove_random_nodes(g, 2).nodes.count() == 4
    h = spark.range(1).select(priority(F.lit(big), 3, 42).alias("h")).first().h
    x = (big * 1103515245 + 3 * 12345 + 42) % 2147483648
    assert h == x * (x + 1) % 2147483647


def test_sparse_random_graphs(spark):
    g = mis.sparse_random_graph(spark, 100_000, 0.0001, 3)
    n = g.edges.where("src < dst").count()
    assert abs(n - 500_000) < 5 * 500_000**0.5
    assert g.edges.where("src = dst or src < 0 or dst >= 100000").isEmpty()


def test_frozen_chains_of_an_earlier_run(spark):
    g = random_dag(spark, graphs=1, n=12)
    first = lanes.lanes(g, 3)
    later = mutate.remove_random_nodes(g, 3)
    left = {r.node_id for r in later.nodes.collect()}
    order = sorted((r.lane, r.topo_id, r.node_id) for r in first.collect() if r.node_id in left)
    chains = {(a[2], b[2]) for a, b in zip(order, order[1:]) if a[0] == b[0]}
    got = {(r.src, r.dst) for r in lanes.frozen_constraints(later, first).edges.collect()}
    assert got == chains | {(r.src, r.dst) for r in later.edges.collect()}
    assert traverse.is_acyclic(lanes.frozen_constraints(later, first)).first().acyclic


def test_timing(spark):
    rows = schedule.timed(spark, {"levels": lambda: spark.range(5), "none": lambda: spark.range(0)}).collect()
    assert [(r.phase, r.rows, r.us > 0) for r in rows] == [("levels", 5, True), ("none", 0, True)]


@pytest.mark.parametrize("mode", ["semaphore", "lanes", "lanes-incremental", None])
def test_turns_in_one_pass(spark, mode):
    """The kernel and the loop over DataFrames make the same choices, also where
    graphs run out of nodes."""
    g = random_dag(spark, graphs=3, n=9, seed=8)
    g = TaskGraph(g.nodes.where("graph_id < 2 or node_id < 3"), g.edges.where("graph_id < 2 or dst < 3"))
    run = (lambda s: schedule.incremental_runs(g, mode, 2, 5, most=3, seed=5, strategy=s)) if mode else (lambda s: mutate.incremental_stats(g, 2, 5, 5, strategy=s))
    found = [run(s) for s in ("grouped", "loop")]
    a, b = (sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr) for df in found)
    assert a == b and len(a) >= 4


def test_edges_that_fall_are_looked_through(spark):
    g = random_dag(spark, graphs=2, n=8)
    ordered = traverse.topo_order(g)
    first = ordered.where("graph_id = 0").orderBy("topo_id").collect()
    back = spark.createDataFrame([(0, first[-1].node_id, first[0].node_id)], "graph_id long, src long, dst long")
    more = mutate.add_edges(g, back)
    found = {r.graph_id: r.acyclic for r in mutate.still_acyclic(more, ordered, back).collect()}
    assert found == {r.graph_id: r.acyclic for r in traverse.is_acyclic(more).collect()}
    assert all(r.acyclic for r in mutate.still_acyclic(g, ordered, back.limit(0)).collect())


def test_a_thousand_turns(spark):
    """The length that graphs are worked on at in practice."""
    g = random_dag(spark, graphs=2, n=30)
    rows = schedule.incremental_runs(g, "lanes", 1000, 3, seed=3).collect()
    assert len(rows) == 2000 and {r.nodes for r in rows} == {30}
    assert [r.k for r in sorted(rows, key=lambda r: (r.graph_id, r.iter))[:15]] == [mutate.parallelism_bounce(t) for t in range(15)]
    assert all(r.widest <= r.k and r.tasks == 30 for r in rows)
