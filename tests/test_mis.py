import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dagloom.graph import Hypergraph, UndirectedGraph
from dagloom.functions.numbers import priority, priority_of
from dagloom.operators import mis
from dagloom.queries import SEED, spark_queries


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(2)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(120)}
    vertices = spark.createDataFrame([(v,) for v in range(40)], "v long")
    return UndirectedGraph.of(vertices, spark.createDataFrame(sorted(pairs), "src long, dst long")), pairs


def scan(order, pairs):
    near = {v: set() for v in range(40)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    out = set()
    for v in order:
        if not near[v] & out:
            out.add(v)
    return out


def test_greedy_is_the_scan(spark, graph):
    g, pairs = graph
    assert {r.v for r in mis.mis(g).collect()} == scan(range(40), pairs)


@pytest.mark.parametrize("algo", ["greedy", "priority", "luby"])
def test_valid(spark, graph, algo):
    chosen = mis.mis(graph[0], algo)
    assert mis.is_independent(graph[0], chosen).first()[0]
    assert mis.is_maximal(graph[0], chosen).first()[0]


def test_checks_see_faults(spark, graph):
    g, pairs = graph
    a, b = next(iter(pairs))
    both = spark.createDataFrame([(a,), (b,)], "v long")
    assert not mis.is_independent(g, both).first()[0]
    assert not mis.is_maximal(g, both.limit(0)).first()[0]


def test_random_graph(spark):
    g = mis.random_graph(spark, 50, 0.2)
    n = mis.count_edges(g).first()[0]
    assert 150 < n < 350 and g.edges.count() == 2 * n


def test_whole_part_graph(spark, tmp_path):
    """Orders of all keys count, not only of those that ten divides."""
    rng = random.Random(5)
    items = [(o, rng.randrange(40)) for o in range(1, 60) for _ in range(3)]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    by_order = {}
    for o, v in items:
        by_order.setdefault(o, set()).add(v)
    pairs = {(a, b) for s in by_order.values() for a in s for b in s if a < b}
    parts = {v for _, v in items}
    near = {v: {b if a == v else a for a, b in pairs if v in (a, b)} for v in parts}
    hashes = {r.v: r.h for r in spark.range(40).select(F.col("id").alias("v"), priority(F.col("id"), 0, SEED).alias("h")).collect()}
    got = {n: [tuple(r) for r in spark_queries()[n](spark, str(tmp_path)).collect()] for n in ("undirected_edge_count", "mis_greedy", "mis_priority", "mis_luby", "mis_independent", "mis_maximal")}
    assert got["undirected_edge_count"] == [(len(pairs),)]
    assert {v for v, in got["mis_greedy"]} == scan(sorted(parts), pairs)
    assert {v for v, in got["mis_priority"]} == scan(sorted(parts, key=lambda v: (hashes[v], v)), pairs)
    luby = {v for v, in got["mis_luby"]}
    assert all((v in luby) != bool(near[v] & luby) for v in parts)
    assert got["mis_independent"] == [(True,)] and got["mis_maximal"] == [(True,)]


def hypergraph(spark, items, lone=()):
    members = spark.createDataFrame(sorted(set(items)), "e long, v long")
    return Hypergraph(spark.createDataFrame(sorted({(v,) for _, v in items} | {(v,) for v in lone}), "v long"), members)


def plain_rounds(items, lone, rank):
    """Rounds of vertices that are first in all their hyperedges, as sets."""
    out, left, turn = set(lone), set(items), 0
    while left:
        of = {}
        for e, v in left:
            of.setdefault(e, set()).add(v)
        first = {v for _, v in left}
        for s in of.values():
            first -= s - {max(s, key=lambda v: rank(v, turn))}
        gone = {u for s in of.values() if s & first for u in s}
        left = {(e, v) for e, v in left if v not in gone}
        out, turn = out | first, turn + 1
    return out


@pytest.mark.parametrize("tail", [0, 300, 200_000])
@pytest.mark.parametrize("far", [0, 10**12])
def test_rounds_on_incidence_rows(spark, monkeypatch, tail, far):
    """DataFrame rounds, one task's rounds and a mix of both give the same, for
    ids that are packed with their hashes and ids that are not."""
    monkeypatch.setattr(mis, "TAIL_ROWS", tail)
    rng = random.Random(8)
    items = [(e, far + rng.randrange(150)) for e in range(120) for _ in range(rng.randrange(1, 8))]
    lone = [far + 500, far + 501]
    g = hypergraph(spark, items, lone)
    hashed = lambda v, t: int(priority_of(np.array([v]), t, SEED)[0])
    ranks = {"greedy": lambda v, t: -v, "priority": lambda v, t: (-hashed(v, 0), -v), "luby": lambda v, t: (hashed(v, t), v)}
    for algo, rank in ranks.items():
        got = [r.v for r in mis.mis(g, algo, SEED).collect()]
        assert sorted(got) == sorted(plain_rounds(items, lone, rank)), algo


def test_order_of_many_parts(spark):
    """A hyperedge of m vertices costs m rows: no pairs are made."""
    many = spark.range(100_000).select(F.lit(0).alias("e"), F.col("id").alias("v"))
    more = spark.range(1, 30_000).select((F.col("id") % 9_000 + 1).alias("e"), (F.col("id") * 7 % 130_000).alias("v"))
    members = many.union(more).distinct()
    g = Hypergraph(members.select("v").distinct(), members)
    for algo in ("greedy", "luby"):
        chosen = mis.mis(g, algo)
        assert mis.is_independent(g, chosen).first()[0] and mis.is_maximal(g, chosen).first()[0]


@pytest.mark.parametrize("heavy", [0, 3, 500])
def test_pairs_are_counted_once(spark, monkeypatch, heavy):
    """Whatever hyperedges' pairs are made or counted by class."""
    monkeypatch.setattr(mis, "HEAVY", heavy)
    rng = random.Random(9)
    items = {(e, rng.randrange(40)) for e in range(25) for _ in range(rng.randrange(1, 9))} | {(100, v) for v in range(0, 40, 2)} | {(101, v) for v in range(20)}
    pairs = {(a, b) for e, a in items for f, b in items if e == f and a < b}
    assert mis.count_edges(hypergraph(spark, items)).first().n_edges == len(pairs)
    many = spark.range(200_000).select(F.lit(0).alias("e"), F.col("id").alias("v"))
    if heavy == 500:
        assert mis.count_edges(Hypergraph(many.select("v"), many)).first().n_edges == 200_000 * 199_999 // 2


def test_report(spark, graph):
    rows = {r.algo: r for r in mis.report(graph[0]).collect()}
    assert set(rows) == {"greedy", "priority", "luby"} and all(r.independent and r.maximal for r in rows.values())
    assert rows["greedy"].size == len(scan(range(40), graph[1]))
    lists = [{r.v for r in mis.mis(graph[0], a).collect()} for a in rows]
    assert [r.size for r in rows.values()] == [len(s) for s in lists]


def test_report_stores_rows_once(spark, monkeypatch):
    """The three algorithms share their rounds: what they store is about the
    incidence rows, not a copy for each of them."""
    monkeypatch.setattr(mis, "TAIL_ROWS", 300)
    rng = random.Random(11)
    items = {(e, rng.randrange(400)) for e in range(1500) for _ in range(4)}
    g, stored, cut = hypergraph(spark, items), [], mis.cut

    def counted(df):
        out = cut(df)
        stored.append(out.count())
        return out

    monkeypatch.setattr(mis, "cut", counted)
    rows = mis.report(g, SEED).collect()
    assert sum(stored) < 2.5 * len(items)
    monkeypatch.setattr(mis, "TAIL_ROWS", 200_000)
    assert [r["size"] for r in rows] == [mis.mis(g, r.algo, SEED).count() for r in rows]
    assert all(r.independent and r.maximal for r in rows)


@pytest.mark.parametrize("broadcast", [0, 1_000_000])
@pytest.mark.parametrize("ids", [range(-50, 50), range(2**40, 2**40 + 90)])
def test_marks(spark, monkeypatch, broadcast, ids):
    monkeypatch.setattr(mis, "BROADCAST_ROWS", broadcast)
    rng = random.Random(3)
    marks = [(rng.choice(ids), 1 << rng.randrange(3)) for _ in range(40)]
    want = {v: 0 for v in ids}
    for v, t in marks:
        want[v] |= t
    df = spark.createDataFrame([(v,) for v in ids], "v long")
    got = {how: {r.v: r.t for r in mis._marked(df, "v", spark.createDataFrame(marks, "v long, t int"), 3, how).collect()} for how in ("left", "inner")}
    assert got == {"left": want, "inner": {v: t for v, t in want.items() if t}}


def test_hashes_agree(spark):
    ids = [0, 1, 2**31, 10**15, 2**40 + 5]
    df = spark.createDataFrame([(i,) for i in ids], "v long")
    for turn in (0, 7):
        got = {r.v: r.h for r in df.select("v", priority(F.col("v"), turn, SEED).alias("h")).collect()}
        assert [got[i] for i in ids] == priority_of(np.array(ids), turn, SEED).tolist()
