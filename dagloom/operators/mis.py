"""Maximal independent sets of undirected graphs and hypergraphs.

Sets are found on incidence rows (e, v): v is a vertex of the hyperedge e, and
vertices of one hyperedge are neighbours.  Pairs of neighbours are never made,
so a hyperedge of m vertices costs m rows.  An edge of a graph is a hyperedge of
two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dagloom.functions.numbers import priority, priority_of
from dagloom.graph import Hypergraph, UndirectedGraph
from dagloom.plans.fixpoint import cut

#: Neighbours that are tried from one row.
CHUNK = 100_000
#: Vertices of the largest hyperedge of which pairs are made.
HEAVY = 500
#: Incidence rows up to which the remaining rounds run in one task.
TAIL_ROWS = 200_000
#: Words of marks up to which they are broadcast (about 64 MB).
BROADCAST_ROWS = 1_000_000
ALGORITHMS = ("greedy", "priority", "luby")


def random_graph(spark: SparkSession, n: int, chance: float, seed: int = 42) -> UndirectedGraph:
    """Each pair u < v is an edge with that chance, by a hash of the pair."""
    u = spark.range(n).toDF("src").where(F.col("src") < n - 1)
    lead = u.select("src", F.explode(F.sequence(F.col("src") + 1, F.lit(n - 1).cast("long"), F.lit(CHUNK).cast("long"))).alias("from"))
    pairs = lead.select("src", F.explode(F.sequence("from", F.least(F.col("from") + CHUNK - 1, F.lit(n - 1).cast("long")))).alias("dst"))
    coin = F.pmod(priority(F.col("src") * n + F.col("dst"), 0, seed), F.lit(1_000_000)) < F.lit(int(chance * 1_000_000))
    return UndirectedGraph.of(spark.range(n).toDF("v"), pairs.where(coin))


def sparse_random_graph(spark: SparkSession, n: int, chance: float, seed: int = 42) -> UndirectedGraph:
    """The same distribution without looking at every pair: each u draws the
    gaps between its neighbours, of a generator of its own."""
    if not 0 < chance < 1:
        return random_graph(spark, n, chance, seed)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for u in b.column(0).to_pylist():
                rng, at = np.random.default_rng([seed, u]), u
                while at < n:
                    places = at + np.cumsum(rng.geometric(chance, 1024))
                    at = int(places[-1])
                    found = places[places < n]
                    yield pa.record_batch([pa.array(np.full(len(found), u)), pa.array(found)], ["src", "dst"])

    return UndirectedGraph.of(spark.range(n).toDF("v"), spark.range(n).mapInArrow(draw, "src long, dst long"))


def count_edges(g: UndirectedGraph | Hypergraph) -> DataFrame:
    """(n_edges): pairs of neighbours, each once.  Pairs are made of hyperedges
    of up to HEAVY vertices only.  Vertices of larger ones are counted by
    class: those that are in the same large hyperedges are alike, so classes
    that share one are neighbours as wholes."""
    if isinstance(g, UndirectedGraph):
        return g.edges.where("src < dst").agg(F.count("*").alias("n_edges"))
    size = g.members.groupBy("e").agg(F.count("*").alias("n"))
    heavy = size.where(F.col("n") > HEAVY).select("e")
    light = g.members.join(heavy, "e", "left_anti")
    pairs = light.withColumnRenamed("v", "a").join(light.withColumnRenamed("v", "b"), "e").where("a < b").select("a", "b").distinct()
    if heavy.isEmpty():
        return pairs.agg(F.count("*").alias("n_edges"))
    of = cut(g.members.join(heavy, "e", "left_semi").groupBy("v").agg(F.array_sort(F.collect_list("e")).alias("of")))
    classes = cut(of.groupBy("of").agg(F.count("*").alias("n")).withColumn("c", F.monotonically_increasing_id()))
    by_edge = classes.select("c", "n", F.explode("of").alias("e"))
    met = by_edge.toDF("a", "na", "e").join(by_edge.toDF("b", "nb", "e"), "e").where("a < b").select("a", "b", "na", "nb").distinct()
    within = classes.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("x"))
    between = met.agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("x"))
    at = lambda c: of.select(F.col("v").alias(c), F.col("of").alias(f"of_{c}"))
    more = pairs.join(at("a"), "a", "left").join(at("b"), "b", "left").where("not coalesce(arrays_overlap(of_a, of_b), false)")
    more = more.agg(F.count("*").alias("x"))
    return within.unionByName(between).unionByName(more).agg(F.sum("x").alias("n_edges"))


def _incidence(g: UndirectedGraph | Hypergraph) -> Hypergraph:
    """Members are read several times, so those made here are stored."""
    if isinstance(g, Hypergraph):
        return g
    both = g.edges.where("src < dst").select(F.struct("src", "dst").alias("e"), F.explode(F.array("src", "dst")).alias("v"))
    return Hypergraph(g.vertices, cut(both))


def _key(algo: str, seed: int, packed: bool) -> tuple[Callable[[int], Column], Callable[[Column], Column]]:
    """What vertices are compared by in a round, the largest comes first, and
    the vertex of such a key.  "greedy" and "priority" prefer low ids and low
    hashes, "luby" draws new hashes each round and prefers high ones; ties go to
    the id alike."""
    v = F.col("v")
    if algo == "greedy":
        return lambda turn: -v, lambda k: -k
    last = 2**32 - 1 if packed else 0
    if packed:  # a hash has 31 bits
        wide, low = lambda h, x: F.shiftleft(h, 32) + x, lambda k: k.bitwiseAND(F.lit(2**32 - 1))
    else:
        wide, low = lambda h, x: F.struct(h.alias("h"), x.alias("x")), lambda k: k["x"]
    if algo == "luby":
        return lambda turn: wide(priority(v, turn, seed), v), low
    return lambda turn: wide(F.lit(2**31 - 1) - priority(v, 0, seed), F.lit(last) - v), lambda k: F.lit(last) - low(k)


def _marked(df: DataFrame, c: str, marks: DataFrame, k: int, how: str = "inner") -> DataFrame:
    """df with t, the bits (k at most) that some row of marks (c, t) sets for
    its c; inner: rows with such a bit only.  Bits of neighbouring whole numbers
    are one row, so that those of millions of vertices can be broadcast and df
    stays where it is, in its order; beyond BROADCAST_ROWS it is shuffled."""
    word, shift = F.col(c), F.lit(0)
    if dict(marks.dtypes)[c] in ("int", "bigint"):
        place = F.pmod(F.col(c), F.lit(63 // k))
        word, shift = F.expr(f"({c} - pmod({c}, {63 // k}L)) div {63 // k}L"), (place * k).cast("int")
    bits = F.call_function("shiftleft", F.col("t").cast("long"), shift)
    words = cut(marks.select(word.alias("__word"), bits.alias("__bits")).groupBy("__word").agg(F.bit_or("__bits").alias("__bits")))
    words = F.broadcast(words) if words.count() <= BROADCAST_ROWS else words
    t = F.coalesce(F.call_function("shiftright", F.col("__bits"), shift).bitwiseAND(F.lit(2**k - 1)), F.lit(0)).cast("int")
    out = df.withColumn("__word", word).join(words, "__word", how).withColumn("t", t).select(*df.columns, "t")
    return out.where("t <> 0") if how == "inner" else out


def _tail(algos: tuple[str, ...], seed: int, turn: int) -> Callable:
    """The rounds from ``turn`` on over one task's rows."""

    def one(e: np.ndarray, ids: np.ndarray, v: np.ndarray, algo: str) -> Iterator[np.ndarray]:
        now = turn
        while len(v):
            if algo == "greedy":
                by = np.argsort(-ids, kind="stable")
            elif algo == "priority":
                by = np.lexsort((-ids, -priority_of(ids, 0, seed)))
            else:
                by = np.lexsort((ids, priority_of(ids, now, seed)))
            rank = np.empty(len(ids), np.int64)
            rank[by] = np.arange(len(ids))
            top, seen = np.full(e.max() + 1, -1), np.full(len(ids), -1)
            np.maximum.at(top, e, rank[v])
            np.maximum.at(seen, v, top[e])
            taken = seen == rank
            yield ids[taken]
            hit = np.zeros(len(top), bool)
            hit[e[taken[v]]] = True
            gone = np.zeros(len(ids), bool)
            gone[v[hit[e]]] = True
            e, v = e[~gone[v]], v[~gone[v]]
            now += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        rows = pa.Table.from_batches(held)
        e = np.array(pa.concat_arrays(rows.column("e").chunks).dictionary_encode().indices)
        m = rows.column("m").to_numpy()
        for i, algo in enumerate(algos):
            live = (m >> i & 1).astype(bool)
            ids, v = np.unique(rows.column("v").to_numpy()[live], return_inverse=True)
            for taken in one(e[live], ids, v, algo):
                yield pa.record_batch([pa.array(taken), pa.array(np.full(len(taken), 1 << i, np.int32))], ["v", "t"])

    return run


def _rounds(g: Hypergraph, algos: tuple[str, ...], seed: int) -> tuple[DataFrame, int]:
    """(v, t), bit i of t for the set of algos[i], and the rounds over
    DataFrames it took: in each, vertices that come first in all their
    hyperedges are taken, and all vertices of those hyperedges leave with their
    rows.  All algorithms go through the same rows, with a bit of m for each in
    which the vertex is still there.  A vertex that stays keeps all its rows, so
    it comes first in all hyperedges if it does in as many as it has at first:
    only the first of each hyperedge are sent to be counted.  Few rows that are
    left go through the same rounds in one task."""
    k = len(algos)
    ends = g.vertices.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    packed = ends["lo"] is not None and ends["lo"] >= 0 and ends["hi"] < 2**32
    keys = [_key(algo, seed, packed) for algo in algos]
    every = F.lit(2**k - 1).cast("int")
    members = g.members.select("e", F.col("v").cast("long").alias("v"))
    degrees = cut(members.groupBy("v").agg(F.count("*").alias("n")))
    out = g.vertices.select(F.col("v").cast("long").alias("v")).join(degrees, "v", "left_anti").select("v", every.alias("t"))
    live, turn = members.withColumn("m", every), 0
    while True:
        if live.count() <= TAIL_ROWS:
            named = live.select(F.col("e").cast("string").alias("e"), "v", "m")
            return out.unionByName(named.coalesce(1).mapInArrow(_tail(algos, seed, turn), "v long, t int")), turn
        there = [F.when(F.col("m").bitwiseAND(F.lit(1 << i)) != 0, key(turn)) for i, (key, _) in enumerate(keys)]
        tops = live.groupBy("e").agg(*[F.max(c).alias(f"k{i}") for i, c in enumerate(there)])
        first = [F.struct(vertex(F.col(f"k{i}")).alias("v"), F.lit(1 << i).alias("t")) for i, (_, vertex) in enumerate(keys)]
        first = tops.select(F.explode(F.array(*first)).alias("x")).select("x.v", "x.t").where("v is not null")
        first = first.groupBy("v", "t").agg(F.count("*").alias("first"))
        taken = cut(first.join(degrees, "v").where("first = n").groupBy("v").agg(F.bit_or("t").alias("t")))
        hit = _marked(live, "v", taken, k).select("e", "t")
        gone = _marked(live, "e", hit, k).select("v", F.col("t").bitwiseAND(F.col("m")).alias("t"))
        left = _marked(live, "v", gone, k, "left").withColumn("m", F.col("m").bitwiseAND(F.bitwise_not("t")))
        live = cut(left.where("m <> 0").select("e", "v", "m"))
        out, turn = out.unionByName(taken), turn + 1


def mis(g: UndirectedGraph | Hypergraph, algo: str = "greedy", seed: int = 42) -> DataFrame:
    """(v): "greedy" gives the lexicographically first set, as a scan by id
    does; "priority" scans by a hash of the id; "luby" draws anew each round."""
    if algo not in ALGORITHMS:
        raise ValueError(f"no such algorithm: {algo}")
    return _rounds(_incidence(g), (algo,), seed)[0].select("v")


def rounds(g: UndirectedGraph | Hypergraph, algo: str = "greedy", seed: int = 42) -> int:
    """Rounds over DataFrames that mis takes before one task does the rest."""
    return _rounds(_incidence(g), (algo,), seed)[1]


def violations(g: UndirectedGraph | Hypergraph, chosen: DataFrame) -> DataFrame:
    """(e, n): hyperedges that have n > 1 chosen vertices."""
    met = _incidence(g).members.join(chosen, "v", "left_semi")
    return met.groupBy("e").agg(F.count("*").alias("n")).where("n > 1")


def uncovered(g: UndirectedGraph | Hypergraph, chosen: DataFrame) -> DataFrame:
    """Vertices that are neither chosen nor next to a chosen one."""
    g = _incidence(g)
    hit = g.members.join(chosen, "v", "left_semi").select("e").distinct()
    near = g.members.join(hit, "e", "left_semi").select("v")
    return g.vertices.join(chosen, "v", "left_anti").join(near, "v", "left_anti")


def is_independent(g: UndirectedGraph | Hypergraph, chosen: DataFrame) -> DataFrame:
    return violations(g, chosen).agg((F.count("*") == 0).alias("independent"))


def is_maximal(g: UndirectedGraph | Hypergraph, chosen: DataFrame) -> DataFrame:
    return uncovered(g, chosen).agg((F.count("*") == 0).alias("maximal"))


def report(g: UndirectedGraph | Hypergraph, seed: int = 42) -> DataFrame:
    """(algo, size, independent, maximal) of the three algorithms, found and
    checked together: what is chosen more than once in a hyperedge, and what is
    neither chosen nor next to a chosen one."""
    g, k = _incidence(g), len(ALGORITHMS)
    of = lambda i: F.col("t").bitwiseAND(F.lit(1 << i)) != 0
    count = lambda *c: [F.coalesce(F.sum(x.cast("long")), F.lit(0)) for x in c]
    each = lambda c: [x.alias(f"x{i}") for i, x in enumerate(count(*c))]
    chosen = cut(_rounds(g, ALGORITHMS, seed)[0])
    met = _marked(g.members.select("e", F.col("v").cast("long").alias("v")), "v", chosen, k).groupBy("e").agg(*each(of(i) for i in range(k)), F.bit_or("t").alias("t"))
    met = cut(met)
    near = _marked(g.members, "e", met.select("e", "t"), k).select(F.col("v").cast("long").alias("v"), "t")
    seen = _marked(g.vertices.select(F.col("v").cast("long").alias("v")), "v", near.unionByName(chosen), k, "left")
    sizes, twice, lost = chosen.agg(*each(of(i) for i in range(k))), met.agg(*each(F.col(f"x{i}") > 1 for i in range(k))), seen.agg(*each(~of(i) for i in range(k)))
    name = lambda df, c: df.toDF(*[f"{c}{i}" for i in range(k)])
    row = name(sizes, "size").crossJoin(name(twice, "twice")).crossJoin(name(lost, "lost"))
    found = [F.struct(F.lit(a).alias("algo"), F.col(f"size{i}").alias("size"), (F.col(f"twice{i}") == 0).alias("independent"), (F.col(f"lost{i}") == 0).alias("maximal")) for i, a in enumerate(ALGORITHMS)]
    return row.select(F.explode(F.array(*found)).alias("x")).select("x.*")
