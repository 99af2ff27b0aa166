"""Goldens, properties and negative cases of the task-graph operators."""

import random

import pytest

from dagloom.graph import TaskGraph
from dagloom.operators import cluster, lanes, mutate, schedule, traverse

CHAIN17 = "0-1 0-15 1-2 1-13 2-3 3-4 3-6 4-5 6-7 8-9 9-10 10-11 11-12 12-14 13-14 14-15 15-16"


def graph17(spark):
    return TaskGraph.from_lists(spark, list(range(17)), [tuple(map(int, e.split("-"))) for e in CHAIN17.split()])


def random_dag(spark, graphs=3, n=30, seed=1):
    rng = random.Random(seed)
    nodes = [(g, v) for g in range(graphs) for v in range(n)]
    edges = []
    for g in range(graphs):
        for _ in range(2 * n):
            a, b = sorted(rng.sample(range(n), 2))
            edges.append((g, a, b))  # pairs may repeat
    return TaskGraph.from_lists(spark, nodes, edges)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_golden_fifo_and_lanes(spark):
    g = graph17(spark)
    got = rows(traverse.topo_order(g, "fifo"), "node_id", "level", "lid", "topo_id")
    assert [r[1] for r in got] == [0, 1, 2, 3, 4, 5, 4, 5, 0, 1, 2, 3, 4, 2, 5, 6, 7]
    assert [r[2] for r in got] == [0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 2, 1, 2, 1, 2, 0, 0]
    assert [r[3] for r in got] == [0, 2, 4, 7, 9, 12, 10, 13, 1, 3, 6, 8, 11, 5, 14, 15, 16]
    four = lanes.lanes(g, 4, "fifo")
    assert rows(lanes.cross_edges(g, four), "src", "dst") == [(1, 13), (3, 6), (9, 10), (10, 11), (11, 12), (13, 14), (14, 15)]
    assert lanes.lane_chains(four).count() == 14
    two = lanes.lanes(g, 2, "fifo")
    assert rows(lanes.cross_edges(g, two), "src", "dst") == [(1, 13), (3, 6), (9, 10), (10, 11), (11, 12), (13, 14)]
    canonical = lanes.lanes(g, 4)
    assert rows(lanes.cross_edges(g, canonical), "src", "dst") == [(1, 13), (3, 6), (11, 12), (14, 15)]
    one = lanes.lanes(g, 1)
    assert lanes.cross_edges(g, one).count() == 0 and lanes.lane_chains(one).count() == 16


def test_golden_clusters(spark):
    g = graph17(spark)
    got = lambda p: [r[1] for r in rows(cluster.convex_clusters(g, p), "node_id", "cluster_id")]
    assert got(10) == [0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 0, 1, 1, 1]
    assert got(4) == [0, 0, 0, 2, 2, 2, 2, 4, 1, 1, 1, 1, 3, 0, 3, 3, 3]


def test_golden_seven_nodes(spark):
    g = TaskGraph.from_lists(spark, list(range(7)), [(0, 2), (0, 3), (0, 4), (2, 6), (3, 6), (4, 6), (2, 5)])
    for order in ("fifo", "canonical"):
        two = lanes.lanes(g, 2, order)
        assert rows(two, "node_id", "level", "lid", "topo_id", "lane") == [
            (0, 0, 0, 0, 0), (1, 0, 1, 1, 1), (2, 1, 0, 2, 0), (3, 1, 1, 3, 1), (4, 1, 2, 4, 0), (5, 2, 0, 5, 0), (6, 2, 1, 6, 1),
        ]
        assert rows(lanes.cross_edges(g, two), "src", "dst") == [(0, 3), (4, 6)]


def test_strategies_agree(spark):
    g = random_dag(spark)
    for order in ("canonical", "fifo"):
        a, b = (rows(traverse.topo_order(g, order, s), "graph_id", "node_id", "level", "lid", "topo_id") for s in ("grouped", "loop"))
        assert a == b
    a, b = (rows(cluster.convex_clusters(g, 4, s), "graph_id", "node_id", "cluster_id") for s in ("grouped", "loop"))
    assert a == b


def test_invariants(spark):
    g = random_dag(spark, seed=7)
    at = {(r.graph_id, r.node_id): r.cluster_id for r in cluster.convex_clusters(g, 5).collect()}
    edges = [(r.graph_id, r.src, r.dst) for r in g.edges.collect()]
    assert all(at[x, a] <= at[x, b] for x, a, b in edges)
    sizes = {}
    for (x, _), c in at.items():
        sizes[x, c] = sizes.get((x, c), 0) + 1
    assert max(sizes.values()) <= 5 and len(at) == 90
    laned = lanes.lanes(g, 3)
    plans = {
        "free": (schedule.schedule(g), g, None),
        "semaphore": (schedule.schedule(g, 3), g, 3),
        "lanes": (schedule.schedule_lanes(g, laned), lanes.lane_graph(g, laned), 3),
        "incremental": (schedule.schedule_lanes(g, laned, incremental=True), g, 3),
    }
    for plan, ordered, width in plans.values():
        wave = {(r.graph_id, r.node_id): r.wave for r in plan.collect()}
        assert len(wave) == 90
        assert all(wave[r.graph_id, r.src] < wave[r.graph_id, r.dst] for r in ordered.edges.collect())
        assert all(wave[x, a] < wave[x, b] for x, a, b in edges)
        if width:
            assert plan.groupBy("graph_id", "wave").count().agg({"count": "max"}).first()[0] <= width
    assert all(r.acyclic for r in lanes.union_acyclic(g, lanes.lane_graph(g, laned).edges).collect())
    assert all(r.agrees for r in lanes.order_certificate(lanes.lane_graph(g, laned).edges, laned).collect())


def test_cycles(spark):
    g = TaskGraph.from_lists(spark, [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)], [(0, 0, 1), (0, 1, 2), (0, 2, 1), (1, 0, 1), (1, 1, 0)])
    assert rows(traverse.unreachable_from_sources(g), "graph_id", "has_unreachable") == [(0, False), (1, True)]
    for s in ("grouped", "loop"):
        assert rows(traverse.is_acyclic(g, s), "graph_id", "acyclic") == [(0, False), (1, False)]
    with pytest.raises(Exception, match="cycle"):
        traverse.checked_levels(g).collect()


def test_empty_and_bad_parameters(spark):
    g = TaskGraph.empty(spark)
    assert traverse.topo_order(g).count() == 0 and traverse.stats(g).count() == 0
    assert cluster.convex_clusters(g, 3).count() == 0
    for bad in (lambda: lanes.lanes(g, 0), lambda: cluster.convex_clusters(g, 0), lambda: schedule.schedule(g, 0), lambda: mutate.sample_ints(spark, 3, 4)):
        with pytest.raises(ValueError):
            bad()


def test_multi_edges(spark):
    g = TaskGraph.from_lists(spark, [0, 1], [(0, 1), (0, 1)])
    assert rows(traverse.degrees(g), "node_id", "num_fanins", "num_fanouts") == [(0, 0, 2), (1, 2, 0)]
    assert rows(traverse.levels(g), "node_id", "level") == [(0, 0), (1, 1)]
    c = cluster.convex_clusters(g, 1)
    assert rows(cluster.quotient_edges(g, c), "c_src", "c_dst", "multiplicity") == [(0, 1, 2)]
    assert cluster.quotient(g, c, dedupe=False).edges.count() == 4
    assert traverse.chain_edges(g).count() == 0


def walked(nodes, edges):
    """Reverse post-order of a depth-first walk from each source, in the order
    of the lists."""
    seen, post = set(), []

    def visit(v):
        seen.add(v)
        for a, b in edges:
            if a == v and b not in seen:
                visit(b)
        post.append(v)

    for v in nodes:
        if v not in seen and v not in {b for _, b in edges}:
            visit(v)
    return post[::-1]


def test_dfs_order(spark):
    got = [r[1] for r in rows(traverse.dfs_order(graph17(spark)), "dfs_id", "node_id")]
    assert got == walked(list(range(17)), [tuple(map(int, e.split("-"))) for e in CHAIN17.split()])
    g = random_dag(spark, seed=4)
    found = rows(traverse.dfs_order(g), "graph_id", "dfs_id", "node_id")
    edges = sorted((r.graph_id, r.edge_seq, r.src, r.dst) for r in g.edges.collect())
    for x in range(3):
        assert [v for y, _, v in found if y == x] == walked(list(range(30)), [(a, b) for y, _, a, b in edges if y == x])


def test_mutations_keep_graphs_sound(spark):
    g = random_dag(spark, graphs=2, n=20, seed=3)
    for _, h, found in mutate.incremental(g, 2, 3):
        assert rows(found, "graph_id", "nodes", "acyclic") == [(0, 20, True), (1, 20, True)]
        nodes = {(r.graph_id, r.node_id) for r in h.nodes.collect()}
        assert all((r.graph_id, r.src) in nodes and (r.graph_id, r.dst) in nodes for r in h.edges.collect())
    assert [mutate.parallelism_bounce(i) for i in range(15)] == [8, 7, 6, 5, 4, 3, 2, 1, 2, 3, 4, 5, 6, 7, 8]
    few = mutate.remove_random_nodes(g, 100)
    assert few.nodes.count() == 0 and few.edges.count() == 0
