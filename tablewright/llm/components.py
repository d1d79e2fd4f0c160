"""Connected components of an edge table: union inside each task, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.session import materialise

#: Edges that one task joins at a time (16 bytes each).
TASK_EDGES = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``node, root`` of every node that is not its own root; the root is the smallest node reached."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)  # roots hang below smaller roots
        while (root != root[root]).any():
            root = root[root]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


def _contracted(edges: DataFrame, most: int) -> DataFrame:
    """The same components by the forests of the tasks' own edges, ``most`` of them at a time: never more edges than before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def joined() -> pa.RecordBatch:
            u, v = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest(u, v)], ["u", "v"])

        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                if size and size + part.num_rows > most:
                    yield joined()
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if held:
            yield joined()

    return edges.mapInArrow(run, "u bigint, v bigint")


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """``node, label``: every node of ``edges`` (u, v) with the smallest node it is connected to.

    Nodes are longs, not null; direction, repeats and loops do not matter (a node of loops alone
    gives no row); no edges give no rows.  Tasks first join the edges they hold, so what is shuffled is a forest
    of each task.  Once ``task_edges`` or fewer are left, one task of that bounded size joins them;
    beyond that each round rewires edges to the smallest neighbour known.
    """
    edges = materialise(_contracted(edges.filter("u <> v").select("u", "v"), task_edges), "edges")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] <= task_edges:
            edges = materialise(_contracted(edges.coalesce(1), task_edges), "edges")
            break
        if now == before:
            break
        before = now
        both = edges.union(edges.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        # large star: larger neighbours go to the smallest one
        large = both.join(least, "u").filter("v > u AND v <> m").selectExpr("v AS u", "m AS v").distinct()
        # small star: the neighbours below a node, and the node, go to the smallest of them
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").selectExpr("IF(v = m, u, v) AS u", "m AS v").distinct()
        edges = materialise(_contracted(small, task_edges).distinct(), "edges")
    return edges.selectExpr("u AS node", "v AS label").union(edges.selectExpr("v AS node", "v AS label").distinct())
