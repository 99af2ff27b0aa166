"""Many turns of change over whole graphs in one pass.

``mutate.incremental`` and ``schedule.incremental_runs`` change all graphs by a
few DataFrame jobs a turn.  Graphs that fit a task don't meet, so a bucket of
them can go through all turns at once; this is the kernel that does so.  It
makes the same choices, so both give the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

from dagloom.functions.numbers import priority_of
from dagloom.operators.kernels import _kahn, rank_within

FOUND = "iter long, graph_id long, nodes long, edges long, acyclic boolean"
RUNS = "iter long, k long, graph_id long, waves long, tasks long, widest long, nodes long, edges long, acyclic boolean"


def _most(group: np.ndarray, value: np.ndarray, groups: int) -> np.ndarray:
    """The largest value of each group, -1 where there is none."""
    out = np.full(groups, -1, np.int64)
    np.maximum.at(out, group, value)
    return out


@dataclass
class _Graphs:
    """Nodes: graph (from 0), id, place in the list.  Edges: graph, place in the
    list, and the ends' indexes among the nodes."""

    graph: np.ndarray
    node: np.ndarray
    eg: np.ndarray
    seq: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    count: int

    def levels(self, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
        order = np.argsort(src, kind="stable")
        return _kahn(len(self.node), src[order], dst[order])[0]

    def without_nodes(self, gone: np.ndarray) -> _Graphs:
        index = np.cumsum(~gone) - 1
        left = ~(gone[self.src] | gone[self.dst])
        return _Graphs(self.graph[~gone], self.node[~gone], self.eg[left], self.seq[left], index[self.src[left]], index[self.dst[left]], self.count)

    def without_edges(self, gone: np.ndarray) -> _Graphs:
        return _Graphs(self.graph, self.node, self.eg[~gone], self.seq[~gone], self.src[~gone], self.dst[~gone], self.count)

    def with_edges(self, eg: np.ndarray, src: np.ndarray, dst: np.ndarray) -> _Graphs:
        """Numbered on by (src, dst)."""
        seq = _most(self.eg, self.seq, self.count)[eg] + 1 + rank_within(eg, self.node[dst], self.node[src])
        join = lambda a, b: np.concatenate([a, b])
        return _Graphs(self.graph, self.node, join(self.eg, eg), join(self.seq, seq), join(self.src, src), join(self.dst, dst), self.count)

    def changed(self, turn: int, n: int, seed: int, tries: int) -> _Graphs:
        """See mutate.incremental."""
        g = self.without_nodes(rank_within(self.graph, self.node, priority_of(self.node, turn, seed)) < n)
        g = g.without_edges(rank_within(g.eg, g.seq, priority_of(g.seq, turn, seed)) < n)
        g = g.with_edges(*g.new_edges(turn, n, seed, tries))
        return g.with_nodes(turn, n, seed)

    def new_edges(self, turn: int, n: int, seed: int, tries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """See mutate.random_edges."""
        level = self.levels(self.src, self.dst)
        known = np.flatnonzero(level >= 0)
        known = known[np.lexsort((self.node[known], level[known], self.graph[known]))]  # by graph and place
        size = np.bincount(self.graph[known], minlength=self.count)
        first = np.cumsum(size) - size
        some = np.flatnonzero(size > 1)
        draws = np.arange(tries * n + 100 if n else 0)
        graph, draw = np.repeat(some, len(draws)), np.tile(draws, len(some))
        i = priority_of(draw * 2, turn, seed) % (size[graph] - 1)
        j = i + 1 + priority_of(draw * 2 + 1, turn, seed) % (size[graph] - 1 - i)
        src, dst = known[first[graph] + i], known[first[graph] + j]
        pair = src * np.int64(len(self.node)) + dst
        new = ~np.isin(pair, self.src * np.int64(len(self.node)) + self.dst)
        _, once = np.unique(pair[new], return_index=True)  # the first draw of a pair
        at = np.sort(np.flatnonzero(new)[once])
        at = at[rank_within(graph[at], draw[at]) < n]
        return graph[at], src[at], dst[at]

    def with_nodes(self, turn: int, n: int, seed: int) -> _Graphs:
        """See mutate.random_nodes."""
        by_id = np.lexsort((self.node, self.graph))
        size = np.bincount(self.graph, minlength=self.count)
        first = np.cumsum(size) - size
        some = np.flatnonzero(size > 0)
        graph = np.repeat(some, n)
        node = self.node[by_id][(first + size - 1)[graph]] + 1 + np.tile(np.arange(n), len(some))
        old = by_id[first[graph] + priority_of(node, turn, seed) % size[graph]]
        own = len(self.node) + np.arange(len(node))
        leads = priority_of(node, turn, seed + 1) % 2 == 0
        g = _Graphs(np.append(self.graph, graph), np.append(self.node, node), self.eg, self.seq, self.src, self.dst, self.count)
        return g.with_edges(graph, np.where(leads, own, old), np.where(leads, old, own))

    def run(self, mode: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Waves, tasks and the widest wave of each graph; see schedule."""
        level = self.levels(self.src, self.dst)
        lid = rank_within(self.graph * np.int64(len(self.node) + 2) + level, self.node)
        if mode == "semaphore":
            width = pd.Series(lid[level >= 0]).groupby([self.graph[level >= 0], level[level >= 0]]).max() + 1
            graph = width.index.get_level_values(0).to_numpy()
            waves = np.bincount(graph, weights=-(-width.to_numpy() // k), minlength=self.count).astype(np.int64)
            return waves, np.bincount(self.graph[level >= 0], minlength=self.count), np.minimum(_most(graph, width.to_numpy(), self.count), k)
        _, src, dst = self.limited(level, lid, k, mode == "lanes")
        wave = self.levels(src, dst)
        width = pd.Series(1, range(len(wave))).groupby([self.graph, wave]).sum()
        graph = width.index.get_level_values(0).to_numpy()
        return _most(self.graph, wave, self.count) + 1, np.bincount(self.graph, minlength=self.count), _most(graph, width.to_numpy(), self.count)

    def limited(self, level: np.ndarray, lid: np.ndarray, k: int, prune: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each node's lane, and the ends of the edges that keep k lanes in
        order: their chains and the graph's edges, or, if pruned, those between
        lanes that must be kept."""
        lane, topo = lid % k, rank_within(self.graph, self.node, level)
        order = np.lexsort((topo, lane, self.graph))
        next_ = (self.graph[order][1:] == self.graph[order][:-1]) & (lane[order][1:] == lane[order][:-1])
        kept = np.arange(len(self.src))
        if prune:
            across = np.flatnonzero(lane[self.src] != lane[self.dst])
            across = across[np.lexsort((-self.seq[across], topo[self.src[across]], self.dst[across]))]
            last = np.append(self.dst[across][1:] != self.dst[across][:-1], True)[: len(across)]
            last_lane = np.empty(len(self.node), np.int64)
            last_lane[self.dst[across[last]]] = lane[self.src[across[last]]]
            kept = across[last | (lane[self.src[across]] != last_lane[self.dst[across]])]
        return lane, np.append(order[:-1][next_], self.src[kept]), np.append(order[1:][next_], self.dst[kept])


def _graphs(nodes: pd.DataFrame, edges: pd.DataFrame) -> tuple[np.ndarray, _Graphs]:
    names, graph = np.unique(nodes["graph_id"], return_inverse=True)
    at = pd.MultiIndex.from_frame(nodes[["graph_id", "node_id"]])
    src, dst = (at.get_indexer(pd.MultiIndex.from_arrays([edges["graph_id"], edges[c]])) for c in ("src", "dst"))
    if len(edges) and min(src.min(), dst.min()) < 0:
        raise ValueError("an edge names no node")
    return names, _Graphs(graph, nodes["node_id"].to_numpy(), graph[src], edges["edge_seq"].to_numpy(), src, dst, len(names))


def turns(nodes: pd.DataFrame, edges: pd.DataFrame, parallel: list[int], n: int, seed: int, mode: str | None, tries: int = 20) -> pd.DataFrame:
    """RUNS of the graphs, a turn for each number of parallel, or, without a
    mode, FOUND; graphs that have lost all nodes have no more rows of FOUND and
    null counts, once, in RUNS."""
    names, g = _graphs(nodes, edges)
    out = []
    for turn, k in enumerate(parallel):
        before = np.bincount(g.graph, minlength=g.count) > 0
        ran = g.run(mode, k) if mode else ()
        g = g.changed(turn, n, seed, tries)
        size = np.bincount(g.graph, minlength=g.count)
        stuck = np.bincount(g.graph[g.levels(g.src, g.dst) < 0], minlength=g.count) > 0
        columns = {"iter": turn, "graph_id": names}
        if mode:
            columns |= {"k": k, "waves": ran[0], "tasks": ran[1], "widest": ran[2]}
        frame = pd.DataFrame(columns | {"nodes": size, "edges": np.bincount(g.eg, minlength=g.count), "acyclic": ~stuck})
        if mode:
            for c in ("nodes", "edges"):
                frame[c] = frame[c].astype("Int64").where(size > 0)
        out.append(frame[before if mode else size > 0])
    return pd.concat(out, ignore_index=True)


def lane_waves(nodes: pd.DataFrame, edges: pd.DataFrame, k: int, prune: bool) -> pd.DataFrame:
    """(graph_id, node_id, wave, slot) of k lanes; see schedule.run_lanes."""
    names, g = _graphs(nodes, edges)
    level = g.levels(g.src, g.dst)
    lane, src, dst = g.limited(level, rank_within(g.graph * np.int64(len(g.node) + 2) + level, g.node), k, prune)
    if len(level) and level.min() < 0:
        raise ValueError("the graph has a cycle")
    return pd.DataFrame({"graph_id": names[g.graph], "node_id": g.node, "wave": g.levels(src, dst), "slot": lane})


def lane_edges(nodes: pd.DataFrame, edges: pd.DataFrame, k: int, prune: bool) -> pd.DataFrame:
    """(graph_id, src, dst) of the edges that keep k lanes in order."""
    names, g = _graphs(nodes, edges)
    level = g.levels(g.src, g.dst)
    if len(level) and level.min() < 0:
        raise ValueError("the graph has a cycle")
    _, src, dst = g.limited(level, rank_within(g.graph * np.int64(len(g.node) + 2) + level, g.node), k, prune)
    return pd.DataFrame({"graph_id": names[g.graph[src]], "src": g.node[src], "dst": g.node[dst]})
