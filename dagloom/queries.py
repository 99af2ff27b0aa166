"""Registered queries over the star-schema tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagloom.functions.numbers import payload, priority_sql
from dagloom.graph import Hypergraph, TaskGraph
from dagloom.operators import cluster, lanes, log, mis, mutate, schedule, traverse
from dagloom.plans.fixpoint import cut
from dagloom.sources.tables import conversation_graph, event_graph, event_log, key_graph, part_orders, table
from dagloom.sources.text import dot_lines, harness_averages

Query = Callable[[SparkSession, str], DataFrame]

CLUSTER, LANES, PARALLEL, CHANGES, SEED, TURNS = 4, 4, 8, 2, 42, 3

# ---------------------------------------------------------------- Spark


def _events(f: Callable) -> Query:
    return lambda spark, sf: f(event_graph(spark, sf))


def _clusters(f: Callable) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        g = event_graph(spark, sf)
        return f(g, cluster.convex_clusters(g, CLUSTER))

    return run


def _lanes(f: Callable) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        g = event_graph(spark, sf)
        return f(g, lanes.lanes(g, LANES))

    return run


def _logged(f: Callable) -> Query:
    return lambda spark, sf: f(log.apply_log(event_graph(spark, sf), event_log(spark, sf)))


def _parts(f: Callable) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        g = part_orders(spark, sf)
        members = cut(g.members)
        return f(Hypergraph(cut(members.select("v").distinct()), members))

    return run


def _node_ids(g) -> DataFrame:
    return g.nodes.select("graph_id", "node_id")


def _edge_ends(g) -> DataFrame:
    return g.edges.select("graph_id", "src", "dst")


def _new_node_edges(g) -> DataFrame:
    nodes, edges = mutate.random_nodes(g, CHANGES, SEED)
    at = nodes.select("graph_id", "node_id")
    return edges.join(at, (edges.graph_id == at.graph_id) & F.col("node_id").isin(edges.src, edges.dst)).select(edges.graph_id, "node_id", "src", "dst")


def _incremental_runs(mode: str) -> Query:
    return _events(lambda g: schedule.incremental_runs(g, mode, TURNS, CHANGES, PARALLEL, SEED))


def _frozen(g, laned: DataFrame) -> DataFrame:
    """The first run's chains in a graph that has lost some nodes since."""
    return _edge_ends(lanes.frozen_constraints(mutate.remove_random_nodes(g, CHANGES, SEED), laned))


def _by_parity(g) -> DataFrame:
    """A clustering that is not convex."""
    return cluster.quotient_acyclic(g, g.nodes.select("graph_id", "node_id", F.pmod("node_id", F.lit(2)).alias("cluster_id")))


def _with_some_reversed(g) -> DataFrame:
    back = g.edges.where("graph_id % 3 = 0").select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return lanes.union_acyclic(g, back)


def _every_third(g) -> DataFrame:
    """A set that is neither independent nor maximal in general."""
    chosen = g.vertices.where("v % 3 = 0")
    return mis.is_independent(g, chosen).crossJoin(mis.is_maximal(g, chosen))


def parallelism_sweep(spark: SparkSession, sf: str) -> DataFrame:
    ordered = cut(traverse.topo_order(event_graph(spark, sf)))
    out = None
    for k in (8, 6, 4, 2):
        row = schedule.run_totals(schedule.in_lots(ordered, k)).withColumn("k", F.lit(k).cast("long"))
        out = row if out is None else out.unionByName(row)
    return out


def harness(spark: SparkSession, sf: str) -> DataFrame:
    """Three runs' output lines, made of orders, by status as the benchmark."""
    orders = table(spark, sf, "orders")
    run = F.pmod("o_orderkey", F.lit(3))
    line = F.concat(F.lit("run time: "), F.floor("o_totalprice").cast("long").cast("string"), F.lit(" us"))
    return harness_averages(orders.select(F.col("o_orderstatus").alias("benchmark"), run.alias("run"), F.col("o_orderkey").alias("line_no"), line.alias("line")))


def spark_queries() -> dict[str, Query]:
    return {
        "graph_stats": _events(traverse.stats),
        "node_degrees": _events(traverse.degrees),
        "source_nodes": _events(traverse.sources),
        "sink_nodes": _events(traverse.sinks),
        "undirected_edge_count": _parts(mis.count_edges),
        "key_graph_levels": lambda spark, sf: traverse.checked_levels(key_graph(spark, sf)),
        "levels": _events(traverse.levels),
        "level_widths": _events(lambda g: traverse.levels(g).groupBy("graph_id", "level").agg(F.count("*").alias("width"))),
        "topo_canonical": _events(traverse.topo_order),
        "topo_fifo": _events(lambda g: traverse.topo_order(g, "fifo")),
        "topo_dfs": _events(traverse.dfs_order),
        "unreachable_from_sources": lambda spark, sf: traverse.unreachable_from_sources(conversation_graph(spark, sf, planted=True)),
        "is_acyclic": lambda spark, sf: traverse.is_acyclic(conversation_graph(spark, sf, planted=True)),
        "chain_edges": lambda spark, sf: traverse.chain_edges(conversation_graph(spark, sf)),
        "chain_ids": lambda spark, sf: traverse.chain_ids(conversation_graph(spark, sf)),
        "convex_clusters": _clusters(lambda g, c: c),
        "cluster_sizes": _clusters(lambda g, c: cluster.cluster_members(c).drop("members")),
        "quotient_edges": _clusters(cluster.quotient_edges),
        "quotient_acyclic": _clusters(cluster.quotient_acyclic),
        "lane_assign": _lanes(lambda g, x: x.select("graph_id", "node_id", "lane")),
        "lane_chains": _lanes(lambda g, x: lanes.lane_chains(x)),
        "lane_cross_edges": _lanes(lanes.cross_edges),
        "lane_graph": _events(lambda g: lanes.limited_edges(g, LANES)),
        "lane_union_acyclic": _lanes(lambda g, x: lanes.union_acyclic(g, lanes.lane_graph(g, x).edges)),
        "lane_order_certificate": _lanes(lambda g, x: lanes.order_certificate(lanes.lane_graph(g, x).edges, x)),
        "lane_incremental_edges": _events(lambda g: lanes.limited_edges(g, LANES, incremental=True)),
        "lane_incremental_acyclic": _lanes(lambda g, x: lanes.union_acyclic(g, lanes.lane_chains(x))),
        "schedule_unbounded": _events(schedule.schedule),
        "schedule_clusters": _clusters(schedule.schedule_clusters),
        "schedule_semaphore": _events(lambda g: schedule.schedule(g, PARALLEL)),
        "schedule_lanes": _events(lambda g: schedule.run_lanes(g, LANES)),
        "schedule_lanes_incremental": _events(lambda g: schedule.run_lanes(g, LANES, incremental=True)),
        "parallelism_sweep": parallelism_sweep,
        "payload_checksum": lambda spark, sf: payload(spark, [1, 2, 4, 8]),
        "remove_nodes": _events(lambda g: _node_ids(mutate.remove_random_nodes(g, CHANGES, SEED))),
        "remove_node_edges": _events(lambda g: _edge_ends(mutate.remove_random_nodes(g, CHANGES, SEED))),
        "remove_edges": _events(lambda g: _edge_ends(mutate.remove_random_edges(g, CHANGES, SEED))),
        "add_edges": _events(lambda g: mutate.random_edges(g, CHANGES, SEED)),
        "add_nodes": _events(_new_node_edges),
        "log_nodes": _logged(lambda g: g.nodes),
        "log_edges": _logged(lambda g: g.edges),
        "insert_nodes": _events(lambda g: mutate.add_nodes(g, mutate.random_nodes(g, CHANGES, SEED)[0]).nodes),
        "insert_edges": _events(lambda g: mutate.add_edges(g, mutate.random_edges(g, CHANGES, SEED)).edges),
        "sample_ints": lambda spark, sf: mutate.sample_ints(spark, 1000, 50, SEED),
        "parallelism_bounce": lambda spark, sf: spark.range(30).select(F.col("id").alias("iter"), mutate.parallelism_bounce(F.col("id")).alias("k")),
        "incremental_stats": _events(lambda g: mutate.incremental_stats(g, TURNS, CHANGES, SEED)),
        "mis_greedy": _parts(lambda g: mis.mis(g, "greedy")),
        "mis_priority": _parts(lambda g: mis.mis(g, "priority", SEED)),
        "mis_luby": _parts(lambda g: mis.mis(g, "luby", SEED)),
        "mis_independent": _parts(lambda g: mis.is_independent(g, mis.mis(g, "luby", SEED))),
        "mis_maximal": _parts(lambda g: mis.is_maximal(g, mis.mis(g, "luby", SEED))),
        "mis_checks_planted": _parts(_every_third),
        "quotient_acyclic_planted": _events(_by_parity),
        "union_acyclic_planted": _events(_with_some_reversed),
        "lane_frozen_edges": _lanes(_frozen),
        "incremental_semaphore_runs": _incremental_runs("semaphore"),
        "incremental_lane_runs": _incremental_runs("lanes"),
        "incremental_chain_runs": _incremental_runs("lanes-incremental"),
        "mis_report": _parts(lambda g: mis.report(g, SEED)),
        "random_graph": lambda spark, sf: mis.random_graph(spark, 100, 0.1, SEED).edges,
        "dot_dump": _events(dot_lines),
        "harness_averages": harness,
    }


# ---------------------------------------------------------------- DuckDB

_EVENTS = """k AS (SELECT epoch_us(ts) // 3600000000 AS gid, event_id AS v, ts, user_id, event_type FROM events),
ee AS (SELECT DISTINCT gid, src, dst FROM (
  SELECT gid, v AS src, lead(v) OVER (PARTITION BY gid, user_id ORDER BY ts, v) AS dst FROM k UNION ALL
  SELECT gid, v, lead(v) OVER (PARTITION BY gid, event_type ORDER BY ts, v) FROM k) WHERE dst IS NOT NULL)"""
_LEVELS = _EVENTS + """,
p(gid, v, d) AS (SELECT gid, v, 0 FROM k UNION SELECT ee.gid, ee.dst, p.d + 1 FROM p JOIN ee ON p.gid = ee.gid AND p.v = ee.src),
lv AS (SELECT gid, v, max(d)::BIGINT AS level FROM p GROUP BY ALL)"""
_ORDER = _LEVELS + """,
o AS (SELECT gid, v, level, row_number() OVER (PARTITION BY gid, level ORDER BY v) - 1 AS lid,
  row_number() OVER (PARTITION BY gid ORDER BY level, v) - 1 AS topo FROM lv)"""
_CLUSTERS = _LEVELS + f""",
st(it, gid, v, level, cl) AS (
  SELECT 0, gid, v, level, CASE WHEN level = 0 THEN row_number() OVER (PARTITION BY gid, level ORDER BY v) - 1 ELSE -1 END FROM lv
  UNION ALL
  SELECT it + 1, gid, v, level, CASE WHEN level <> it + 1 THEN cl WHEN rk + cnt <= {CLUSTER} THEN d
    ELSE mx + sum(CASE WHEN level = it + 1 AND rk + cnt > {CLUSTER} THEN 1 ELSE 0 END) OVER (PARTITION BY gid ORDER BY v ROWS UNBOUNDED PRECEDING) END
  FROM (SELECT s.*, dd.d, coalesce(cc.cnt, 0) AS cnt, m.mx, row_number() OVER (PARTITION BY s.gid, s.level, dd.d ORDER BY s.v) AS rk
    FROM st s
    LEFT JOIN (SELECT e.gid, e.dst, max(x.cl) AS d FROM ee e JOIN st x ON x.gid = e.gid AND x.v = e.src GROUP BY ALL) dd ON dd.gid = s.gid AND dd.dst = s.v
    LEFT JOIN (SELECT gid, cl, count(*) AS cnt FROM st WHERE cl >= 0 GROUP BY ALL) cc ON cc.gid = s.gid AND cc.cl = dd.d
    LEFT JOIN (SELECT gid, max(cl) AS mx FROM st GROUP BY ALL) m ON m.gid = s.gid
    WHERE s.it < (SELECT max(level) FROM lv))),
cl AS (SELECT gid, v, cl::BIGINT AS c FROM st WHERE it = (SELECT max(it) FROM st)),
qe AS (SELECT e.gid, a.c AS s, b.c AS d, count(*) AS n FROM ee e JOIN cl a ON a.gid = e.gid AND a.v = e.src JOIN cl b ON b.gid = e.gid AND b.v = e.dst
  WHERE a.c <> b.c GROUP BY ALL)"""
_FIFO = _LEVELS + """,
st(it, gid, v, level, topo, lid) AS (
  SELECT 0, gid, v, level, CASE WHEN level = 0 THEN row_number() OVER (PARTITION BY gid, level ORDER BY v) - 1 END,
    CASE WHEN level = 0 THEN row_number() OVER (PARTITION BY gid, level ORDER BY v) - 1 END FROM lv
  UNION ALL
  SELECT it + 1, gid, v, level,
    CASE WHEN level = it + 1 THEN done + row_number() OVER (PARTITION BY gid, level ORDER BY rt, rp) - 1 ELSE topo END,
    CASE WHEN level = it + 1 THEN row_number() OVER (PARTITION BY gid, level ORDER BY rt, rp) - 1 ELSE lid END
  FROM (SELECT s.*, rr.rt, rr.rp, dn.done FROM st s
    LEFT JOIN (SELECT e.gid, e.dst, max(x.topo) AS rt, max_by(e.dst, x.topo) AS rp FROM ee e JOIN st x ON x.gid = e.gid AND x.v = e.src
      WHERE x.topo IS NOT NULL GROUP BY ALL) rr ON rr.gid = s.gid AND rr.dst = s.v
    LEFT JOIN (SELECT gid, count(topo) AS done FROM st GROUP BY ALL) dn ON dn.gid = s.gid
    WHERE s.it < (SELECT max(level) FROM lv)))"""
_LANES = _ORDER + f""",
ln AS (SELECT *, lid % {LANES} AS lane FROM o),
ch AS (SELECT * FROM (SELECT gid, lane, v AS src, lead(v) OVER (PARTITION BY gid, lane ORDER BY topo) AS dst FROM ln) WHERE dst IS NOT NULL),
xe AS (SELECT e.gid, e.src, e.dst, a.lane AS la, a.topo AS t FROM ee e JOIN ln a ON a.gid = e.gid AND a.v = e.src JOIN ln b ON b.gid = e.gid AND b.v = e.dst
  WHERE a.lane <> b.lane),
la AS (SELECT gid, dst, max(t) AS t, max_by(la, t) AS la FROM xe GROUP BY ALL),
r AS (SELECT xe.gid, xe.src, xe.dst FROM xe JOIN la ON la.gid = xe.gid AND la.dst = xe.dst WHERE xe.t = la.t OR xe.la <> la.la),
rc AS (SELECT gid, src, dst FROM r UNION ALL SELECT gid, src, dst FROM ch),
ec AS (SELECT gid, src, dst FROM ee UNION ALL SELECT gid, src, dst FROM ch)"""
_WAVES = """,
w(gid, v, d) AS (SELECT gid, v, 0 FROM k UNION SELECT x.gid, x.dst, w.d + 1 FROM w JOIN {edges} x ON w.gid = x.gid AND w.v = x.src)
SELECT w.gid AS graph_id, w.v AS node_id, max(d)::BIGINT AS wave, any_value(ln.lane)::BIGINT AS slot FROM w JOIN ln ON ln.gid = w.gid AND ln.v = w.v GROUP BY w.gid, w.v"""
_CONV = """k AS (SELECT DISTINCT conv_id AS gid, turn AS v FROM conversations),
line AS (SELECT * FROM (SELECT gid, v AS src, lead(v) OVER (PARTITION BY gid ORDER BY v) AS dst FROM k) WHERE dst IS NOT NULL),
ls AS (SELECT gid, list(v ORDER BY v) AS t FROM k GROUP BY gid HAVING count(*) >= 3),
ee AS (SELECT * FROM line UNION ALL SELECT gid, t[-1], t[CASE WHEN ((gid % 3) + 3) % 3 = 0 THEN 2 ELSE 1 END] FROM ls WHERE ((gid % 3) + 3) % 3 < 2)"""
_PARTS = """items AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS v FROM lineitem),
vx AS (SELECT DISTINCT v FROM items),
ue AS (SELECT DISTINCT a.v AS src, b.v AS dst FROM items a JOIN items b ON a.o = b.o WHERE a.v <> b.v)"""
_SCAN = _PARTS + """,
vs AS MATERIALIZED (SELECT vx.v, row_number() OVER (ORDER BY {rank}, vx.v) AS rn, coalesce(list(ue.dst) FILTER (WHERE ue.dst IS NOT NULL), []) AS nb
  FROM vx LEFT JOIN ue ON ue.src = vx.v GROUP BY vx.v),
s(rn, picked) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT vs.rn, CASE WHEN list_has_any(picked, nb) THEN picked ELSE list_append(picked, vs.v) END FROM s JOIN vs ON vs.rn = s.rn + 1)
SELECT unnest(picked) AS v FROM s WHERE rn = (SELECT max(rn) FROM s)"""
_LUBY = _PARTS + f""",
st(it, v, s) AS (SELECT 0, v, 0 FROM vx UNION ALL
  SELECT it + 1, v, CASE WHEN s <> 0 THEN s WHEN win THEN 1 WHEN hit THEN 2 ELSE 0 END FROM (
    WITH a AS (SELECT st.it, st.v, st.s, {priority_sql("st.v", "st.it", SEED)} AS h FROM st WHERE EXISTS (SELECT 1 FROM st WHERE s = 0)),
    m AS (SELECT ue.src AS v, max(row(x.h, x.v)) AS top FROM ue JOIN a x ON x.v = ue.dst WHERE x.s = 0 GROUP BY ue.src),
    b AS (SELECT a.it, a.v, a.s, a.s = 0 AND (m.top IS NULL OR row(a.h, a.v) > m.top) AS win FROM a LEFT JOIN m ON m.v = a.v),
    n AS (SELECT DISTINCT ue.dst AS v FROM ue JOIN b ON b.v = ue.src WHERE b.win)
    SELECT b.it, b.v, b.s, b.win, n.v IS NOT NULL AS hit FROM b LEFT JOIN n ON n.v = b.v))"""

_LUBY_SET = """,
lu AS MATERIALIZED (SELECT v FROM st WHERE it = (SELECT max(it) FROM st) AND s = 1)"""


def _acyclic(nodes: str, edges: str) -> str:
    """By the closure of edges(gid, src, dst), over nodes(gid, v)."""
    return f""", re AS (SELECT gid, src, dst FROM {edges} UNION SELECT re.gid, re.src, x.dst FROM re JOIN {edges} x ON x.gid = re.gid AND x.src = re.dst)
SELECT n.gid AS graph_id, count(re.gid) = 0 AS acyclic FROM {nodes} n LEFT JOIN re ON re.gid = n.gid AND re.src = n.v AND re.dst = n.v GROUP BY n.gid"""


def _checks(chosen: str) -> str:
    return f"""SELECT NOT EXISTS (SELECT 1 FROM ue JOIN {chosen} a ON a.v = ue.src JOIN {chosen} b ON b.v = ue.dst) AS independent,
NOT EXISTS (SELECT 1 FROM vx WHERE v NOT IN (SELECT v FROM {chosen}) AND v NOT IN (SELECT ue.dst FROM ue JOIN {chosen} c ON c.v = ue.src)) AS maximal"""


def _report() -> str:
    """Sizes and checks of the three sets, each found by its own query."""
    sets = {"greedy": _with(_SCAN.format(rank="vx.v"), ""), "priority": _with(_SCAN.format(rank=priority_sql("vx.v", "0", SEED)), ""),
            "luby": _with(_LUBY, "SELECT v FROM st WHERE it = (SELECT max(it) FROM st) AND s = 1")}
    rows = [f"SELECT '{a}' AS algo, (SELECT count(*) FROM {a}) AS size, independent, maximal FROM ({_checks(a)})" for a in sets]
    return f"WITH {_PARTS}, " + ", ".join(f"{a} AS MATERIALIZED ({q})" for a, q in sets.items()) + " " + " UNION ALL ".join(rows)


def _pick(source: str, key: str, turn: str = "0") -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY gid ORDER BY {priority_sql(key, turn, SEED)}, {key}) AS pick FROM {source})"


def _with(body: str, select: str) -> str:
    return f"WITH RECURSIVE {body}\n{select}"


def _draws() -> str:
    """Random rising pairs of places, as drawn for new edges."""
    hi, hj = (priority_sql(f"(try * 2 + {x})", "0", SEED) for x in (0, 1))
    return f""",
sz AS (SELECT gid, count(*) AS n FROM o GROUP BY gid HAVING count(*) > 1),
dr AS (SELECT gid, n, try, {hi} % (n - 1) AS i, {hj} AS h FROM sz, (SELECT unnest(range(0, {20 * CHANGES + 100})) AS try)),
dj AS (SELECT gid, try, i, i + 1 + h % (n - 1 - i) AS j FROM dr),
fo AS (SELECT dj.gid, a.v AS src, b.v AS dst, min(try) AS try FROM dj JOIN o a ON a.gid = dj.gid AND a.topo = i JOIN o b ON b.gid = dj.gid AND b.topo = j
  WHERE NOT EXISTS (SELECT 1 FROM ee WHERE ee.gid = dj.gid AND ee.src = a.v AND ee.dst = b.v) GROUP BY ALL)"""


def _turns(mode: str | None) -> str:
    """Turns of change, each written out: n, e: nodes and edges before it; m, g:
    what removals leave; a: the edges that come; i: the nodes, with the old one
    and the direction of their edge."""
    p = lambda key, turn, more=0: priority_sql(key, str(turn), SEED + more)
    longest = lambda name, nodes, edges: f"{name}(gid, v, d) AS (SELECT gid, v, 0 FROM {nodes} UNION SELECT y.gid, y.dst, x.d + 1 FROM {name} x JOIN {edges} y ON x.gid = y.gid AND x.v = y.src)"
    after = lambda edges: f"coalesce((SELECT max(eseq) + 1 FROM {edges} y WHERE y.gid = x.gid), 0)"
    parts = [_EVENTS, "n0 AS (SELECT gid, v FROM k)", "e0 AS (SELECT gid, row_number() OVER (PARTITION BY gid ORDER BY src, dst) - 1 AS eseq, src, dst FROM ee)"]
    rows = []
    for t in range(TURNS):
        k = mutate.parallelism_bounce(t, PARALLEL)
        if mode:
            parts += [longest(f"q{t}", f"n{t}", f"e{t}"), f"""b{t} AS (SELECT *, (row_number() OVER (PARTITION BY gid, level ORDER BY v) - 1) % {k} AS lane, row_number() OVER (PARTITION BY gid ORDER BY level, v) - 1 AS topo
  FROM (SELECT gid, v, max(d) AS level FROM q{t} GROUP BY ALL))"""]
            wave = f"SELECT gid, level AS wave, count(*) AS w FROM b{t} GROUP BY ALL"
        if mode and mode != "semaphore":
            parts.append(f"""c{t} AS (SELECT * FROM (SELECT gid, v AS src, lead(v) OVER (PARTITION BY gid, lane ORDER BY topo) AS dst FROM b{t}) WHERE dst IS NOT NULL)""")
            kept = f"SELECT gid, src, dst FROM e{t}"
            if mode == "lanes":
                parts.append(f"""x{t} AS (SELECT e.gid, e.src, e.dst, e.eseq, a.lane, a.topo FROM e{t} e JOIN b{t} a ON a.gid = e.gid AND a.v = e.src JOIN b{t} b ON b.gid = e.gid AND b.v = e.dst WHERE a.lane <> b.lane)""")
                kept = f"SELECT gid, src, dst FROM x{t} x WHERE NOT EXISTS (SELECT 1 FROM x{t} y WHERE y.gid = x.gid AND y.dst = x.dst AND y.lane = x.lane AND (y.topo, -y.eseq) > (x.topo, -x.eseq)) OR lane <> (SELECT max_by(y.lane, y.topo) FROM x{t} y WHERE y.gid = x.gid AND y.dst = x.dst)"
            parts += [f"f{t} AS (SELECT * FROM c{t} UNION ALL {kept})", longest(f"w{t}", f"n{t}", f"f{t}")]
            wave = f"SELECT gid, wave, count(*) AS w FROM (SELECT gid, v, max(d) AS wave FROM w{t} GROUP BY ALL) GROUP BY ALL"
        if mode:
            lots = f"sum((w + {k} - 1) // {k})" if mode == "semaphore" else "count(*)"
            parts.append(f"r{t} AS (SELECT gid, {lots}::BIGINT AS waves, sum(w)::BIGINT AS tasks, max(least(w, {k}))::BIGINT AS widest FROM ({wave}) GROUP BY gid)")
        hi, hj = (p(f"(try * 2 + {x})", t) for x in (0, 1))
        parts += [
            f"m{t} AS (SELECT gid, v FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY {p('v', t)}, v) AS pick FROM n{t}) WHERE pick > {CHANGES})",
            f"h{t} AS (SELECT e.* FROM e{t} e SEMI JOIN m{t} a ON a.gid = e.gid AND a.v = e.src SEMI JOIN m{t} b ON b.gid = e.gid AND b.v = e.dst)",
            f"g{t} AS (SELECT gid, eseq, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY {p('eseq', t)}, eseq) AS pick FROM h{t}) WHERE pick > {CHANGES})",
            longest(f"p{t}", f"m{t}", f"g{t}"),
            f"o{t} AS (SELECT gid, v, row_number() OVER (PARTITION BY gid ORDER BY level, v) - 1 AS topo FROM (SELECT gid, v, max(d) AS level FROM p{t} GROUP BY ALL))",
            f"s{t} AS (SELECT gid, count(*) AS n FROM o{t} GROUP BY gid HAVING count(*) > 1)",
            f"d{t} AS (SELECT gid, try, i, i + 1 + h % (n - 1 - i) AS j FROM (SELECT gid, n, try, {hi} % (n - 1) AS i, {hj} AS h FROM s{t}, (SELECT unnest(range(0, {20 * CHANGES + 100})) AS try)))",
            f"""a{t} AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY src, dst) - 1 AS num FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY try) AS pick FROM (
  SELECT d.gid, a.v AS src, b.v AS dst, min(try) AS try FROM d{t} d JOIN o{t} a ON a.gid = d.gid AND a.topo = i JOIN o{t} b ON b.gid = d.gid AND b.topo = j
  ANTI JOIN g{t} g ON g.gid = d.gid AND g.src = a.v AND g.dst = b.v GROUP BY ALL)) WHERE pick <= {CHANGES})""",
            f"j{t} AS (SELECT * FROM g{t} UNION ALL SELECT gid, {after(f'g{t}')} + num, src, dst FROM a{t} x)",
            f"""i{t} AS (SELECT z.gid, z.v, o.v AS old, {p('z.v', t, 1)} % 2 = 0 AS up FROM (SELECT gid, n, top + 1 + i AS v FROM (SELECT gid, count(*) AS n, max(v) AS top FROM m{t} GROUP BY gid), (SELECT unnest(range(0, {CHANGES})) AS i)) z
  JOIN (SELECT gid, v, row_number() OVER (PARTITION BY gid ORDER BY v) - 1 AS place FROM m{t}) o ON o.gid = z.gid AND o.place = {p('z.v', t)} % z.n)""",
            f"n{t + 1} AS (SELECT * FROM m{t} UNION ALL SELECT gid, v FROM i{t})",
            f"""e{t + 1} AS (SELECT * FROM j{t} UNION ALL SELECT gid, {after(f'j{t}')} + row_number() OVER (PARTITION BY gid ORDER BY src, dst) - 1, src, dst
  FROM (SELECT gid, CASE WHEN up THEN v ELSE old END AS src, CASE WHEN up THEN old ELSE v END AS dst FROM i{t}) x)""",
            f"z{t}(gid, src, dst) AS (SELECT gid, src, dst FROM e{t + 1} UNION SELECT x.gid, x.src, y.dst FROM z{t} x JOIN e{t + 1} y ON y.gid = x.gid AND y.src = x.dst)",
            f"""u{t} AS (SELECT gid, count(*) AS nodes, (SELECT count(*) FROM e{t + 1} y WHERE y.gid = x.gid) AS edges, NOT EXISTS (SELECT 1 FROM z{t} y WHERE y.gid = x.gid AND y.src = y.dst) AS acyclic
  FROM n{t + 1} x GROUP BY gid)""",
        ]
        if mode:
            rows.append(f"SELECT {t}::BIGINT AS iter, {k}::BIGINT AS k, gid AS graph_id, waves, tasks, widest, tasks * 1024 AS total, nodes, edges FROM r{t} LEFT JOIN u{t} USING (gid)")
        else:
            rows.append(f"SELECT {t}::BIGINT AS iter, gid AS graph_id, nodes, edges, acyclic FROM u{t}")
    return _with(",\n".join(parts), " UNION ALL ".join(rows))


_LOG = f"""{_EVENTS},
lr AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY v) - 1 AS rk FROM k),
lh AS (SELECT *, min(v) OVER (PARTITION BY gid, rk // 4) AS head, (extract(minute FROM ts) // 10) * 1000000000000 + v AS t FROM lr),
es AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY src, dst) - 1 AS eseq FROM ee),
aa AS (SELECT gid, t, CASE WHEN event_type = 'signup' THEN head ELSE -v END AS v, event_type || '_' || v AS name,
  row_number() OVER (PARTITION BY gid ORDER BY t) - 1 AS num FROM lh WHERE event_type IN ('signup', 'purchase')),
rr AS (SELECT gid, head AS v, t FROM lh WHERE event_type = 'click'),
gone AS (SELECT gid, v, max(t) AS t FROM rr GROUP BY ALL),
ops AS (SELECT gid, v, t, true AS there FROM aa UNION ALL SELECT gid, v, t, false FROM rr),
ae AS (SELECT gid, t, head AS src, v AS dst, row_number() OVER (PARTITION BY gid ORDER BY t) - 1 AS num FROM lh WHERE event_type = 'view'),
en AS (SELECT ae.gid, ae.t, ae.src, ae.dst, ae.num, x.v AS node, max_by(ops.there, ops.t) AS there
  FROM ae, LATERAL (SELECT unnest([ae.src, ae.dst]) AS v) x LEFT JOIN ops ON ops.gid = ae.gid AND ops.v = x.v AND ops.t < ae.t GROUP BY ALL),
ok AS (SELECT en.gid, t, src, dst, num FROM en LEFT JOIN k ON k.gid = en.gid AND k.v = en.node GROUP BY ALL HAVING bool_and(coalesce(there, k.v IS NOT NULL)))"""
_LOG_NODES = """SELECT k.gid AS graph_id, k.v AS node_id, k.v::VARCHAR AS name, row_number() OVER (PARTITION BY k.gid ORDER BY k.v) - 1 AS node_seq FROM k"""


def duckdb_sql() -> dict[str, str]:
    ev = lambda x: _with(_EVENTS, x)
    order = lambda x: _with(_ORDER, x)
    clustered = lambda x: _with(_CLUSTERS, x)
    laned = lambda x: _with(_LANES, x)
    semaphore = """, lo AS (SELECT gid, level, (count(*) + {k} - 1) // {k} AS lots FROM o GROUP BY ALL),
ba AS (SELECT gid, level, coalesce(sum(lots) OVER (PARTITION BY gid ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM lo)"""
    sweep = " UNION ALL ".join(
        f"""SELECT gid AS graph_id, sum((w + {k} - 1) // {k})::BIGINT AS waves, sum(w)::BIGINT AS tasks, max(least(w, {k}))::BIGINT AS widest,
        sum(w)::BIGINT * 1024 AS total, {k}::BIGINT AS k FROM ww GROUP BY gid""" for k in (8, 6, 4, 2)
    )
    edge = "es AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY src, dst) - 1 AS eseq FROM ee)"
    node = "ns AS (SELECT gid, v, row_number() OVER (PARTITION BY gid ORDER BY v) - 1 AS nseq FROM k)"
    gone = f"gone AS (SELECT gid, v FROM {_pick('k', 'v')} WHERE pick <= {CHANGES})"
    mod = lambda a, b: f"((({a}) % ({b}) + ({b})) % ({b}))"
    dot_line = """SELECT gid AS graph_id, nseq + 1 AS line_no, '"' || v || '";' AS line FROM ns UNION ALL
SELECT gid, n + 1 + eseq, '"' || src || '" -> "' || dst || '";' FROM es JOIN c USING (gid) UNION ALL
SELECT gid, 0, 'digraph {' FROM c UNION ALL SELECT gid, n + 2 + coalesce(m, -1), '}' FROM c LEFT JOIN (SELECT gid, max(eseq) AS m FROM es GROUP BY gid) USING (gid)"""
    pairs = "SELECT a.range AS src, b.range AS dst FROM range(100) a JOIN range(100) b ON a.range < b.range"
    coin = f"{priority_sql('src * 100 + dst', '0', SEED)} % 1000000 < 100000"
    return {
        "graph_stats": ev("SELECT gid AS graph_id, count(*) AS num_nodes, coalesce(any_value(e.n), 0) AS num_edges FROM k LEFT JOIN (SELECT gid, count(*) AS n FROM ee GROUP BY gid) e USING (gid) GROUP BY gid"),
        "node_degrees": ev("""SELECT gid AS graph_id, v AS node_id, coalesce(i.n, 0) AS num_fanins, coalesce(u.n, 0) AS num_fanouts FROM k
LEFT JOIN (SELECT gid, dst AS v, count(*) AS n FROM ee GROUP BY ALL) i USING (gid, v) LEFT JOIN (SELECT gid, src AS v, count(*) AS n FROM ee GROUP BY ALL) u USING (gid, v)"""),
        "source_nodes": ev("SELECT gid AS graph_id, v AS node_id FROM k ANTI JOIN (SELECT gid, dst AS v FROM ee) e USING (gid, v)"),
        "sink_nodes": ev("SELECT gid AS graph_id, v AS node_id FROM k ANTI JOIN (SELECT gid, src AS v FROM ee) e USING (gid, v)"),
        "undirected_edge_count": _with(_PARTS, "SELECT count(*) AS n_edges FROM ue WHERE src < dst"),
        "key_graph_levels": """SELECT 0::BIGINT AS graph_id, r_regionkey::BIGINT * 10 AS node_id, 0::BIGINT AS level FROM region UNION ALL
SELECT 0, n_nationkey::BIGINT * 10 + 1, 1 FROM nation UNION ALL SELECT 0, c_custkey * 10 + 2, 2 FROM customer UNION ALL SELECT 0, o_orderkey * 10 + 3, 3 FROM orders""",
        "levels": _with(_LEVELS, "SELECT gid AS graph_id, v AS node_id, level FROM lv"),
        "level_widths": _with(_LEVELS, "SELECT gid AS graph_id, level, count(*) AS width FROM lv GROUP BY ALL"),
        "topo_canonical": order("SELECT gid AS graph_id, v AS node_id, level, lid, topo AS topo_id FROM o"),
        "topo_fifo": _with(_FIFO, "SELECT gid AS graph_id, v AS node_id, level, lid, topo AS topo_id FROM st WHERE it = (SELECT max(it) FROM st)"),
        "topo_dfs": ev("""
, ad AS (SELECT gid, src AS v, list(dst ORDER BY dst) AS ch FROM ee GROUP BY ALL),
rt AS (SELECT gid, list(v ORDER BY v) AS rs FROM (SELECT gid, v FROM k ANTI JOIN (SELECT gid, dst AS v FROM ee) e USING (gid, v)) GROUP BY gid),
st(gid, stack, seen, post, nxt) AS (
  SELECT gid, []::BIGINT[], []::BIGINT[], []::BIGINT[], rs[1] FROM rt UNION ALL
  SELECT gid, stack, seen, post, CASE WHEN len(stack) = 0 THEN list_filter(rs, lambda x: NOT list_contains(seen, x))[1]
    ELSE list_filter(coalesce(ch, []), lambda x: NOT list_contains(seen, x))[1] END FROM (
    SELECT y.*, rt.rs, ad.ch FROM (
      SELECT gid, CASE WHEN nxt IS NOT NULL THEN list_append(stack, nxt) ELSE stack[1:len(stack) - 1] END AS stack,
        CASE WHEN nxt IS NOT NULL THEN list_append(seen, nxt) ELSE seen END AS seen,
        CASE WHEN nxt IS NULL THEN list_append(post, stack[-1]) ELSE post END AS post
      FROM st WHERE nxt IS NOT NULL OR len(stack) > 0) y
    JOIN rt ON rt.gid = y.gid LEFT JOIN ad ON ad.gid = y.gid AND ad.v = y.stack[-1])),
en AS (SELECT gid, unnest(post) AS v, len(post) - generate_subscripts(post, 1) AS dfs FROM st WHERE nxt IS NULL AND len(stack) = 0)
SELECT gid AS graph_id, v AS node_id, dfs AS dfs_id FROM en"""),
        "unreachable_from_sources": _with(_CONV, """, rs AS (SELECT gid, v FROM k ANTI JOIN (SELECT gid, dst AS v FROM ee) e USING (gid, v)
UNION SELECT ee.gid, ee.dst FROM rs JOIN ee ON ee.gid = rs.gid AND ee.src = rs.v)
SELECT gid AS graph_id, count(*) > count(rs.v) AS has_unreachable FROM k LEFT JOIN rs USING (gid, v) GROUP BY gid"""),
        "is_acyclic": _with(_CONV, """, re AS (SELECT gid, src, dst FROM ee UNION SELECT re.gid, re.src, ee.dst FROM re JOIN ee ON ee.gid = re.gid AND ee.src = re.dst)
SELECT k.gid AS graph_id, count(re.gid) = 0 AS acyclic FROM k LEFT JOIN re ON re.gid = k.gid AND re.src = k.v AND re.dst = k.v GROUP BY k.gid"""),
        "chain_edges": _with(_CONV, """SELECT gid AS graph_id, src, dst FROM line JOIN (SELECT gid, src FROM line GROUP BY ALL HAVING count(*) = 1) USING (gid, src)
JOIN (SELECT gid, dst FROM line GROUP BY ALL HAVING count(*) = 1) USING (gid, dst)"""),
        "chain_ids": _with(_CONV, "SELECT gid AS graph_id, v AS node_id, min(v) OVER (PARTITION BY gid) AS chain_id FROM k"),
        "convex_clusters": clustered("SELECT gid AS graph_id, v AS node_id, c AS cluster_id FROM cl"),
        "cluster_sizes": clustered("SELECT gid AS graph_id, c AS cluster_id, count(*) AS size FROM cl GROUP BY ALL"),
        "quotient_edges": clustered("SELECT gid AS graph_id, s AS c_src, d AS c_dst, n AS multiplicity FROM qe"),
        "quotient_acyclic": clustered(", qs AS (SELECT gid, s AS src, d AS dst FROM qe), qv AS (SELECT DISTINCT gid, c AS v FROM cl)" + _acyclic("qv", "qs")),
        "quotient_acyclic_planted": ev(", qs AS (SELECT DISTINCT gid, src % 2 AS src, dst % 2 AS dst FROM ee WHERE src % 2 <> dst % 2), qv AS (SELECT DISTINCT gid, v % 2 AS v FROM k)" + _acyclic("qv", "qs")),
        "union_acyclic_planted": ev(", us AS (SELECT gid, src, dst FROM ee UNION ALL SELECT gid, dst, src FROM ee WHERE gid % 3 = 0)" + _acyclic("k", "us")),
        "lane_frozen_edges": laned(f""", gone AS (SELECT gid, v FROM {_pick('k', 'v')} WHERE pick <= {CHANGES}), l2 AS (SELECT * FROM ln ANTI JOIN gone USING (gid, v))
SELECT gid AS graph_id, src, dst FROM ee WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.gid = ee.gid AND gone.v IN (src, dst)) UNION ALL
SELECT * FROM (SELECT gid, v AS src, lead(v) OVER (PARTITION BY gid, lane ORDER BY topo) AS dst FROM l2) WHERE dst IS NOT NULL"""),
        "lane_assign": laned("SELECT gid AS graph_id, v AS node_id, lane FROM ln"),
        "lane_chains": laned("SELECT gid AS graph_id, lane, src, dst FROM ch"),
        "lane_cross_edges": laned("SELECT gid AS graph_id, src, dst FROM r"),
        "lane_graph": laned("SELECT gid AS graph_id, src, dst FROM rc"),
        "lane_union_acyclic": laned(", us AS (SELECT gid, src, dst FROM ee UNION SELECT gid, src, dst FROM rc)" + _acyclic("k", "us")),
        "lane_order_certificate": laned("""SELECT k.gid AS graph_id, count(*) FILTER (WHERE a.topo >= b.topo) = 0 AS agrees FROM (SELECT DISTINCT gid FROM k) k
LEFT JOIN rc ON rc.gid = k.gid LEFT JOIN ln a ON a.gid = rc.gid AND a.v = rc.src LEFT JOIN ln b ON b.gid = rc.gid AND b.v = rc.dst GROUP BY k.gid"""),
        "lane_incremental_edges": laned("SELECT gid AS graph_id, src, dst FROM ec"),
        "lane_incremental_acyclic": laned(", us AS (SELECT DISTINCT gid, src, dst FROM ec)" + _acyclic("k", "us")),
        "schedule_unbounded": order("SELECT gid AS graph_id, v AS node_id, level AS wave, lid AS slot FROM o"),
        "schedule_clusters": clustered(""", w(gid, c, d) AS (SELECT DISTINCT gid, c, 0 FROM cl UNION SELECT qe.gid, qe.d, w.d + 1 FROM w JOIN qe ON qe.gid = w.gid AND qe.s = w.c)
SELECT w.gid AS graph_id, w.c AS cluster_id, max(w.d)::BIGINT AS wave, any_value(t.n) AS tasks, any_value(t.n) * 1024 AS total
FROM w JOIN (SELECT gid, c, count(*) AS n FROM cl GROUP BY ALL) t ON t.gid = w.gid AND t.c = w.c GROUP BY w.gid, w.c"""),
        "schedule_semaphore": order(semaphore.format(k=PARALLEL) + f" SELECT o.gid AS graph_id, v AS node_id, (base + lid // {PARALLEL})::BIGINT AS wave, lid % {PARALLEL} AS slot FROM o JOIN ba ON ba.gid = o.gid AND ba.level = o.level"),
        "schedule_lanes": _with(_LANES, _WAVES.format(edges="rc")),
        "schedule_lanes_incremental": _with(_LANES, _WAVES.format(edges="ec")),
        "parallelism_sweep": order(f", ww AS (SELECT gid, level, count(*) AS w FROM o GROUP BY ALL) {sweep}"),
        "payload_checksum": "SELECT s::BIGINT AS matrix_size, s::BIGINT * s AS entries, 2 * s::BIGINT AS entry_min, 2 * s::BIGINT AS entry_max, 2 * s::BIGINT * s * s AS total FROM (VALUES (1), (2), (4), (8)) t(s)",
        "remove_nodes": _with(f"{_EVENTS}, {gone}", "SELECT gid AS graph_id, v AS node_id FROM k ANTI JOIN gone USING (gid, v)"),
        "remove_node_edges": _with(f"{_EVENTS}, {gone}", "SELECT gid AS graph_id, src, dst FROM ee WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.gid = ee.gid AND gone.v IN (src, dst))"),
        "remove_edges": _with(f"{_EVENTS}, {edge}", f"SELECT gid AS graph_id, src, dst FROM {_pick('es', 'eseq')} WHERE pick > {CHANGES}"),
        "add_edges": _with(_ORDER + _draws(), f"SELECT gid AS graph_id, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY try) AS r FROM fo) WHERE r <= {CHANGES}"),
        "add_nodes": _with(f"{_EVENTS}, {node}", f""", nn AS (SELECT gid, n, top + 1 + i AS v FROM (SELECT gid, count(*) AS n, max(v) AS top FROM k GROUP BY gid), (SELECT unnest(range(0, {CHANGES})) AS i)),
me AS (SELECT nn.gid, nn.v, ns.v AS old, {mod(priority_sql("nn.v", "0", SEED + 1), "2")} = 0 AS up FROM nn JOIN ns ON ns.gid = nn.gid AND ns.nseq = {priority_sql("nn.v", "0", SEED)} % nn.n)
SELECT gid AS graph_id, v AS node_id, CASE WHEN up THEN v ELSE old END AS src, CASE WHEN up THEN old ELSE v END AS dst FROM me"""),
        "log_nodes": _with(_LOG, f"""SELECT n.* FROM ({_LOG_NODES}) n ANTI JOIN gone ON gone.gid = n.graph_id AND gone.v = n.node_id UNION ALL
SELECT aa.gid, aa.v, min_by(aa.name, aa.t), (SELECT count(*) FROM k WHERE k.gid = aa.gid) + min_by(aa.num, aa.t) FROM aa LEFT JOIN gone ON gone.gid = aa.gid AND gone.v = aa.v
  LEFT JOIN k ON k.gid = aa.gid AND k.v = aa.v WHERE (gone.t IS NULL AND k.v IS NULL) OR aa.t > gone.t GROUP BY aa.gid, aa.v"""),
        "log_edges": _with(_LOG, """, every AS (SELECT gid, eseq, src, dst, -1::BIGINT AS t FROM es UNION ALL
  SELECT ok.gid, coalesce(n, 0) + num, src, dst, t FROM ok LEFT JOIN (SELECT gid, count(*) AS n FROM es GROUP BY gid) c ON c.gid = ok.gid)
SELECT gid AS graph_id, eseq AS edge_seq, src, dst FROM every e WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.gid = e.gid AND gone.v IN (e.src, e.dst) AND gone.t > e.t)
  AND NOT EXISTS (SELECT 1 FROM lh WHERE lh.gid = e.gid AND event_type = 'error' AND rk = e.eseq AND lh.t > e.t)"""),
        "insert_nodes": ev(f""", num AS (SELECT gid, count(*) AS n, max(v) AS top FROM k GROUP BY gid)
SELECT * FROM ({_LOG_NODES}) UNION ALL SELECT gid, top + 1 + i, 'new_' || (n + i) || '_' || i, n + i FROM num, (SELECT unnest(range(0, {CHANGES})) AS i)"""),
        "insert_edges": _with(_ORDER + _draws(), f""", {edge}, na AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY src, dst) - 1 AS i FROM
  (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY try) AS r FROM fo) WHERE r <= {CHANGES})
SELECT gid AS graph_id, eseq AS edge_seq, src, dst FROM es UNION ALL
SELECT na.gid, coalesce(c.n, 0) + i, na.src, na.dst FROM na LEFT JOIN (SELECT gid, count(*) AS n FROM es GROUP BY gid) c ON c.gid = na.gid"""),
        "incremental_stats": _turns(None),
        "incremental_semaphore_runs": _turns("semaphore"),
        "incremental_lane_runs": _turns("lanes"),
        "incremental_chain_runs": _turns("lanes-incremental"),
        "sample_ints": f"SELECT range AS value FROM range(1000) ORDER BY {priority_sql('range', '0', SEED)}, range LIMIT 50",
        "parallelism_bounce": "SELECT range AS iter, 1 + abs(7 - range % 14) AS k FROM range(30)",
        "mis_greedy": _with(_SCAN.format(rank="vx.v"), ""),
        "mis_priority": _with(_SCAN.format(rank=priority_sql("vx.v", "0", SEED)), ""),
        "mis_luby": _with(_LUBY, "SELECT v FROM st WHERE it = (SELECT max(it) FROM st) AND s = 1"),
        "mis_checks_planted": _with(_PARTS + ", third AS (SELECT v FROM vx WHERE v % 3 = 0)", _checks("third")),
        "mis_independent": f"SELECT independent FROM ({_with(_LUBY + _LUBY_SET, _checks('lu'))})",
        "mis_maximal": f"SELECT maximal FROM ({_with(_LUBY + _LUBY_SET, _checks('lu'))})",
        "mis_report": _report(),
        "random_graph": f"SELECT src, dst FROM ({pairs}) WHERE {coin} UNION ALL SELECT dst, src FROM ({pairs}) WHERE {coin}",
        "dot_dump": _with(f"{_EVENTS}, {edge}, {node}, c AS (SELECT gid, count(*) AS n FROM k GROUP BY gid)", dot_line),
        "harness_averages": """SELECT benchmark, 'run time' AS metric, (sum(v) * 1000000 // count(*))::BIGINT / 1e6::DOUBLE AS average FROM (
  SELECT o_orderstatus AS benchmark, o_orderkey % 3 AS run, max_by(floor(o_totalprice)::BIGINT, o_orderkey) AS v FROM orders GROUP BY ALL) GROUP BY benchmark""",
    }
