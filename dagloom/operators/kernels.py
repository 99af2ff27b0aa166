"""Per-bucket graph kernels in numpy, for graphs that fit a task.

A bucket holds whole graphs; rows come as pandas frames of nodes and edges.
"""

from __future__ import annotations

import numpy as np
import pandas as pd


def _indexed(nodes: pd.DataFrame, edges: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """nodes by (graph, node_seq), and for each edge, by (graph, edge_seq), the
    positions of its ends, sorted by source; the edges' order.  Without these
    columns nodes go by id and edges as they come."""
    nodes = nodes.sort_values(["graph_id", "node_seq" if "node_seq" in nodes else "node_id"], ignore_index=True)
    at = pd.MultiIndex.from_frame(nodes[["graph_id", "node_id"]])
    if "edge_seq" in edges:
        edges = edges.sort_values(["graph_id", "edge_seq"], ignore_index=True)
    ends = [at.get_indexer(pd.MultiIndex.from_arrays([edges["graph_id"], edges[c]])) for c in ("src", "dst")]
    if len(edges) and min(e.min() for e in ends) < 0:
        raise ValueError("an edge names no node")
    order = np.argsort(ends[0], kind="stable")
    return nodes, ends[0][order], ends[1][order], order


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, .. (size[0] of them), first[1], .."""
    lead = np.cumsum(size) - size
    return np.repeat(first - lead, size) + np.arange(size.sum())


def _kahn(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Level and release rank of each node, -1 on or behind a cycle; edges are
    sorted by source."""
    first = np.searchsorted(src, np.arange(n))
    out = np.bincount(src, minlength=n)
    waits = np.bincount(dst, minlength=n)
    level, rank = np.full(n, -1), np.full(n, -1)
    front, turn, done = np.flatnonzero(waits == 0), 0, 0
    while len(front):
        level[front], rank[front] = turn, done + np.arange(len(front))
        done += len(front)
        met = dst[_ranges(first[front], out[front])]
        np.subtract.at(waits, met, 1)
        # released where the last of its edges is met, in that order
        back, where = np.unique(met[::-1], return_index=True)
        free = waits[back] == 0
        front = back[free][np.argsort(-where[free], kind="stable")]
        turn += 1
    return level, rank


def _ordered(nodes: pd.DataFrame, level: np.ndarray, rank: np.ndarray) -> pd.DataFrame:
    """Places within the level (lid) and the graph (topo_id) by rank."""
    frame = nodes[["graph_id", "node_id"]].copy()
    frame["level"], frame["rank"] = level, rank
    known = frame[frame["level"] >= 0].sort_values("rank")
    frame["lid"] = known.groupby(["graph_id", "level"]).cumcount()
    frame["topo_id"] = known.groupby("graph_id").cumcount()
    frame["level"] = frame["level"].where(frame["level"] >= 0)
    return frame[["graph_id", "node_id", "level", "lid", "topo_id"]].astype({"level": "Int64", "lid": "Int64", "topo_id": "Int64"})


def level_orders(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Kahn's rounds: level, and the place in the order a queue would give
    within the level (lid) and the graph (topo_id).  Nodes on or behind a cycle
    get nulls."""
    nodes, src, dst, _ = _indexed(nodes, edges)
    return _ordered(nodes, *_kahn(len(nodes), src, dst))


def canonical_orders(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """The same, with places by (level, node_id)."""
    nodes, src, dst, _ = _indexed(nodes, edges)
    level, _ = _kahn(len(nodes), src, dst)
    by = np.lexsort((nodes["node_id"].to_numpy(), level))
    rank = np.empty(len(nodes), np.int64)
    rank[by] = np.arange(len(nodes))
    return _ordered(nodes, level, rank)


def reached(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Nodes that a node without predecessors leads to, themselves included."""
    nodes, src, dst, _ = _indexed(nodes, edges)
    n = len(nodes)
    first, out = np.searchsorted(src, np.arange(n)), np.bincount(src, minlength=n)
    seen = np.bincount(dst, minlength=n) == 0
    front = np.flatnonzero(seen)
    while len(front):
        met = np.unique(dst[_ranges(first[front], out[front])])
        front = met[~seen[met]]
        seen[front] = True
    return nodes.loc[seen, ["graph_id", "node_id"]]


def _climbed(up: np.ndarray, steps: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each place of lists, up being the place before (-1: none), by
    pointer doubling: the list's head, the steps there, for rings the smallest
    low; last, whether the list is a ring."""
    head = up < 0
    above = np.where(head, np.arange(len(up)), up)
    steps = np.where(head, 0, steps)
    for _ in range(len(up).bit_length() + 1):
        if head[above].all():
            break
        steps, low, above = steps + steps[above], np.minimum(low, low[above]), above[above]
    return above, steps, low, ~head[above]


def chains(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """chain_id, place and ring of each node; see traverse.chain_places."""
    nodes, src, dst, _ = _indexed(nodes, edges)
    n = len(nodes)
    link = (np.bincount(src, minlength=n)[src] == 1) & (np.bincount(dst, minlength=n)[dst] == 1)
    up = np.full(n, -1)
    up[dst[link]] = src[link]
    return _listed(nodes, up, (up >= 0).astype(np.int64), nodes["node_id"].to_numpy())


def _listed(nodes: pd.DataFrame, up: np.ndarray, steps: np.ndarray, low: np.ndarray) -> pd.DataFrame:
    root, steps, low, ring = _climbed(up, steps, low)
    chain = np.where(ring, low, nodes["node_id"].to_numpy()[root])
    return nodes[["graph_id", "node_id"]].assign(chain_id=chain, place=np.where(ring, 0, steps), ring=ring)


def list_ends(rows: pd.DataFrame) -> pd.DataFrame:
    """rows (graph_id, node_id, up, steps, low) of list nodes that have a node
    above; nodes above that have no row themselves are heads."""
    at = pd.MultiIndex.from_frame(rows[["graph_id", "node_id"]])
    heads = rows[["graph_id", "up"]].drop_duplicates().rename(columns={"up": "node_id"})
    heads = heads[at.get_indexer(pd.MultiIndex.from_frame(heads)) < 0]
    both = pd.concat([rows[["graph_id", "node_id"]], heads], ignore_index=True)
    index = pd.MultiIndex.from_frame(both)
    up = np.full(len(both), -1)
    up[: len(rows)] = index.get_indexer(pd.MultiIndex.from_arrays([rows["graph_id"], rows["up"]]))
    steps, low = np.zeros(len(both), np.int64), both["node_id"].to_numpy().copy()
    steps[: len(rows)], low[: len(rows)] = rows["steps"], rows["low"]
    return _listed(both, up, steps, low).iloc[: len(rows)]


def weighted_levels(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """nodes (graph_id, node_id, base) and edges (graph_id, src, dst, w): the
    longest way to each node, base or more; null on or behind a cycle."""
    at = pd.MultiIndex.from_frame(nodes[["graph_id", "node_id"]])
    ends = [at.get_indexer(pd.MultiIndex.from_arrays([edges["graph_id"], edges[c]])) for c in ("src", "dst")]
    order = np.argsort(ends[0], kind="stable")
    src, dst, w = ends[0][order], ends[1][order], edges["w"].to_numpy()[order]
    n = len(nodes)
    first, out = np.searchsorted(src, np.arange(n)), np.bincount(src, minlength=n)
    waits, level = np.bincount(dst, minlength=n), nodes["base"].to_numpy().astype(np.int64)
    done, front = np.zeros(n, bool), np.flatnonzero(waits == 0)
    while len(front):
        done[front] = True
        through = _ranges(first[front], out[front])
        met = dst[through]
        np.maximum.at(level, met, np.repeat(level[front], out[front]) + w[through])
        np.subtract.at(waits, met, 1)
        front = np.unique(met)
        front = front[waits[front] == 0]
    return nodes[["graph_id", "node_id"]].assign(level=pd.Series(level, nodes.index, "Int64").where(done))


def rank_within(group: np.ndarray, *by: np.ndarray) -> np.ndarray:
    """The place from 0 of each row within its group, in the order of by (the
    first is looked at last)."""
    order = np.lexsort((*by, group))
    at = np.arange(len(group))
    first = np.diff(group[order], prepend=-1) != 0
    out = np.empty(len(group), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return out


def convex_clusters(nodes: pd.DataFrame, edges: pd.DataFrame, size: int) -> pd.DataFrame:
    """In (level, node_id) order each node joins the greatest cluster of its
    predecessors, or its own as a source, if that has room, and else opens a new
    one.  Predecessors stand on lower levels, so a level is done at once: of its
    nodes that want one cluster the first ones get in."""
    nodes, src, dst, _ = _indexed(nodes, edges)
    level, _ = _kahn(len(nodes), src, dst)
    if len(nodes) and level.min() < 0:
        raise ValueError("the graph has a cycle")
    graph = np.unique(nodes["graph_id"], return_inverse=True)[1]
    node = nodes["node_id"].to_numpy()
    offset = np.searchsorted(graph, np.arange(graph.max(initial=-1) + 2))  # of a graph's clusters among all
    by = np.lexsort((node, graph, level))
    edge = np.argsort(level[dst], kind="stable")
    src, dst = src[edge], dst[edge]
    cluster, held = np.full(len(nodes), -1, np.int64), np.zeros(len(nodes), np.int64)
    top = np.zeros(len(offset), np.int64)  # clusters of each graph
    for now in range(level.max(initial=-1) + 1):
        at = by[np.searchsorted(level[by], now) : np.searchsorted(level[by], now, "right")]
        if now:
            a, z = np.searchsorted(level[dst], (now, now + 1))
            np.maximum.at(cluster, dst[a:z], cluster[src[a:z]])
            want = offset[graph[at]] + cluster[at]
            opens = held[want] + rank_within(want, np.arange(len(at))) >= size
        else:
            opens = np.ones(len(at), bool)
        new = at[opens]
        cluster[new] = top[graph[new]] + rank_within(graph[new], np.arange(len(new)))
        np.add.at(top, graph[new], 1)
        np.add.at(held, offset[graph[at]] + cluster[at], 1)
    return nodes[["graph_id", "node_id"]].assign(cluster_id=cluster)


def depth_first(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Reverse post-order of a depth-first walk from each source in list order;
    nodes that no source reaches are left out."""
    nodes, src, dst, _ = _indexed(nodes, edges)
    n = len(nodes)
    first = np.searchsorted(src, np.arange(n + 1)).tolist()
    target = dst.tolist()
    seen, post = [False] * n, []
    for root in np.flatnonzero(np.bincount(dst, minlength=n) == 0).tolist():
        stack = [(root, first[root])]
        seen[root] = True
        while stack:
            v, e = stack.pop()
            while e < first[v + 1] and seen[target[e]]:
                e += 1
            if e < first[v + 1]:
                stack.append((v, e + 1))
                seen[target[e]] = True
                stack.append((target[e], first[target[e]]))
            else:
                post.append(v)
    frame = nodes.loc[post[::-1], ["graph_id", "node_id"]]
    return frame.assign(dfs_id=frame.groupby("graph_id").cumcount().astype(np.int64))
