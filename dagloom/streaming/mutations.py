"""A log of changes (see ``dagloom.operators.log``) as a stream.

State is kept by graph: which nodes the log has put there or removed, how many
nodes and edges it has added, and the time of its last row.  A batch costs its
own rows: it appends its changes to a table, and no graph is rewritten.
``saved`` folds the changes so far into the graph they started from, which is
the same for any cut of the log into batches.

Rows of a graph may come in any order within a batch; a row that is not later
than those of earlier batches fails the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from dagloom.graph import TaskGraph
from dagloom.operators.log import CHANGES, LOG, fold

__all__ = ["LOG", "run", "saved"]

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Changes(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.there = handle.getMapState("there", "node_id long", "there boolean")
        self.counts = handle.getValueState("counts", "nodes long, edges long, iter long, step long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        log = pd.concat(list(rows), ignore_index=True).sort_values(["iter", "step"], ignore_index=True)
        nodes, edges, *last = self.counts.get() if self.counts.exists() else (0, 0, -(1 << 63), -(1 << 63))
        if (log["iter"][0], log["step"][0]) <= tuple(last):
            raise ValueError(f"graph {key[0]}: the log's row at {log['iter'][0]}, {log['step'][0]} comes after a later one")
        known: dict[int, bool | None] = {}  # what this batch has looked up or changed
        changed: set[int] = set()

        def there(node: int) -> bool | None:
            if node not in known:
                known[node] = self.there.getValue((node,))[0] if self.there.containsKey((node,)) else None
            return known[node]

        number, src_there, dst_there, keep = [], [], [], []
        columns = [log[c].tolist() for c in ("op", "node_id", "src", "dst")]
        for op, node, src, dst in zip(*columns):
            number.append(None)
            ends = (None, None)
            if op in ("add_node", "remove_node"):
                node = int(node)
                keep.append(there(node) is not (op == "add_node"))
                known[node] = op == "add_node"
                changed.add(node)
                if op == "add_node":
                    number[-1], nodes = nodes, nodes + 1
            elif op == "add_edge":
                ends = there(int(src)), there(int(dst))
                keep.append(False not in ends)
                number[-1], edges = edges, edges + 1
            else:
                keep.append(op == "remove_edge")
            src_there.append(bool(ends[0]))
            dst_there.append(bool(ends[1]))
        for node in changed:
            self.there.updateValue((node,), (known[node],))
        self.counts.update((nodes, edges, int(log["iter"].iloc[-1]), int(log["step"].iloc[-1])))
        found = log.assign(graph_id=key[0], number=pd.array(number, "Int64"), src_there=src_there, dst_there=dst_there)
        whole = {c: "Int64" for c in ("node_id", "edge_seq", "src", "dst")}
        yield found[keep].astype(whole)[[c.split()[0] for c in CHANGES.split(", ")]]

    def close(self) -> None:
        pass


def run(log: DataFrame, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Starts the query on a streaming log: its changes go to Parquet in path.
    Map state needs the RocksDB state store, which is set for the session."""
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    found = log.groupBy("graph_id").transformWithStateInPandas(_Changes(), CHANGES, "Append", "None")
    writer = found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def saved(spark: SparkSession, path: str, start: TaskGraph) -> TaskGraph:
    """The graph after all batches that have ended."""
    return fold(start, spark.read.schema(CHANGES).parquet(path))
