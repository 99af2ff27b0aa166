"""Twelve circuits as graph files: every operator against derived values.

The files are not part of this repository; the test reads them from the folder
that DAGLOOM_GRAPHS names, and is skipped without it.
"""

import collections
import os

import pytest

from dagloom.graph import UndirectedGraph
from dagloom.operators import cluster, lanes, mis, schedule, traverse
from dagloom.sources.text import read_graph

# Fixed values, by file: nodes, edges, sources, sinks, levels, widest level,
# chain edges; cross-lane edges of 2, 4, 8 lanes in queue order and in canonical
# order; chain edges of those lanes; waves with 8, 4, 2 tasks at once; clusters,
# crossing edges and distinct ones of at most 10, and of at most 4 nodes; the
# greedy independent set.
CIRCUITS = {
    "c1355": (617, 760, 32, 41, 30, 64, 150, (254, 417, 519), (211, 343, 427), (615, 613, 609), (86, 160, 309), (110, 253, 247), (201, 344, 344), 396),
    "c17": (25, 26, 2, 5, 8, 6, 8, (11, 18, 18), (4, 13, 13), (23, 21, 19), (8, 9, 13), (5, 6, 5), (8, 9, 9), 14),
    "c1908": (757, 979, 25, 33, 42, 50, 145, (380, 627, 756), (387, 612, 714), (755, 753, 749), (116, 208, 390), (140, 362, 349), (253, 475, 475), 502),
    "c432": (483, 619, 7, 36, 46, 36, 116, (223, 385, 460), (232, 344, 405), (481, 479, 475), (83, 133, 251), (125, 261, 253), (160, 296, 296), 313),
    "c499": (604, 742, 32, 41, 30, 64, 150, (267, 434, 535), (218, 363, 435), (602, 600, 596), (84, 156, 303), (102, 239, 234), (200, 338, 338), 387),
    "c880": (791, 994, 26, 60, 46, 87, 179, (399, 625, 772), (363, 633, 749), (789, 787, 783), (118, 218, 407), (167, 370, 360), (258, 461, 461), 510),
    "s27": (81, 87, 10, 6, 26, 10, 42, (24, 41, 42), (18, 30, 34), (79, 77, 73), (27, 32, 47), (17, 23, 20), (29, 35, 35), 45),
    "s344": (526, 625, 56, 11, 48, 56, 215, (225, 387, 435), (225, 361, 419), (524, 522, 518), (89, 150, 273), (111, 210, 200), (192, 291, 290), 319),
    "s349": (550, 649, 56, 11, 48, 56, 227, (246, 392, 456), (242, 375, 433), (548, 546, 542), (94, 160, 288), (110, 209, 193), (196, 295, 294), 331),
    "s400": (626, 752, 69, 5, 48, 69, 244, (263, 457, 541), (266, 450, 523), (624, 622, 618), (105, 178, 328), (138, 264, 248), (220, 346, 346), 380),
    "s510": (849, 1055, 25, 21, 42, 92, 313, (408, 687, 828), (436, 695, 811), (847, 845, 841), (128, 231, 438), (174, 380, 379), (276, 482, 482), 532),
    "simple": (17, 17, 2, 3, 8, 3, 8, (6, 7, 7), (2, 4, 4), (15, 14, 14), (8, 8, 11), (2, 2, 1), (5, 5, 4), 9),
}

FOLDER = os.environ.get("DAGLOOM_GRAPHS", "")
pytestmark = pytest.mark.skipif(not FOLDER, reason="DAGLOOM_GRAPHS names no folder of graph files")


def per_graph(df):
    return collections.Counter(r.graph_id for r in df.select("graph_id").collect())


def test_circuits(spark):
    names = sorted(CIRCUITS)
    g = read_graph(spark, [f"{FOLDER}/{n}.txt" for n in names])
    ordered = traverse.topo_order(g).collect()
    got = {n: [] for n in names}

    def add(counts):
        for k, n in enumerate(names):
            got[n].append(counts[k])

    for df in (g.nodes, g.edges, traverse.sources(g), traverse.sinks(g)):
        add(per_graph(df))
    widths = collections.Counter((r.graph_id, r.level) for r in ordered)
    add(collections.Counter(x for x, _ in widths))
    add({k: max(w for (x, _), w in widths.items() if x == k) for k in range(len(names))})
    add(per_graph(traverse.chain_edges(g)))
    for order in ("fifo", "canonical"):
        laned = [lanes.lanes(g, s, order) for s in (2, 4, 8)]
        crossing = [per_graph(lanes.cross_edges(g, x)) for x in laned]
        add({k: tuple(c[k] for c in crossing) for k in range(len(names))})
    chained = [per_graph(lanes.lane_chains(x)) for x in laned]
    add({k: tuple(c[k] for c in chained) for k in range(len(names))})
    for x in laned:
        for more in (lanes.lane_graph(g, x).edges, lanes.lane_chains(x)):
            assert all(r.acyclic for r in lanes.union_acyclic(g, more).collect())
    plans = [{r.graph_id: r.waves for r in schedule.run_totals(schedule.schedule(g, k)).collect()} for k in (8, 4, 2)]
    add({k: tuple(p[k] for p in plans) for k in range(len(names))})
    for size in (10, 4):
        clusters = cluster.convex_clusters(g, size)
        found = collections.defaultdict(list)
        for r in cluster.quotient_edges(g, clusters).collect():
            found[r.graph_id].append(r.multiplicity)
        many = per_graph(clusters.select("graph_id", "cluster_id").distinct())
        add({k: (many[k], sum(found[k]), len(found[k])) for k in range(len(names))})
        assert all(r.acyclic for r in cluster.quotient_acyclic(g, clusters).collect())
    far = 10_000  # the circuits as one undirected graph
    v = lambda c: f"graph_id * {far} + {c} as "
    whole = UndirectedGraph.of(g.nodes.selectExpr(v("node_id") + "v"), g.edges.selectExpr(v("src") + "src", v("dst") + "dst"))
    add(collections.Counter(r.v // far for r in mis.mis(whole).collect()))
    assert {n: tuple(x) for n, x in got.items()} == CIRCUITS
