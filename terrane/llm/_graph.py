"""Connected components of an edge table by union-find within partitions, contracted until each node has one parent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._memory import lean
from ._store import Scratch

#: Edges of a task on average: what bounds its memory.
TASK_EDGES = 500_000


def smallest_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of all nodes of the edges but those smallest ones."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    low, high = np.minimum(ends[: len(a)], ends[len(a) :]), np.maximum(ends[: len(a)], ends[len(a) :])
    root = np.arange(len(nodes))
    while True:
        # Hook the larger root on the smaller, then halve all paths to the roots.
        x, y = root[low], root[high]
        small, large = np.minimum(x, y), np.maximum(x, y)
        if (small == large).all():
            break
        np.minimum.at(root, large, small)
        while (root[root] != root).any():
            root = root[root]
    apart = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[apart], nodes[root[apart]]


def _whole(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    return tuple(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, dtype=np.int64) for k in (0, 1))  # type: ignore[return-value]


@lean
def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, near = smallest_roots(*_whole(batches))
    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(near, pa.int64())], ["node", "near"])


@lean
def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node with its smallest near one; its others are linked to that."""
    node, near = _whole(batches)
    order = np.lexsort((near, node))
    node, near = node[order], near[order]
    first = np.append(True, node[1:] != node[:-1])[: len(node)]
    least = near[first][np.cumsum(first) - 1]
    more = near != least
    arrays = [np.concatenate(x) for x in ((node[first], near[more]), (near[first], least[more]), (np.zeros(int(first.sum()), bool), np.ones(int(more.sum()), bool)))]
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["node", "near", "more"])


def components(edges: DataFrame, scratch: Scratch, *, task_edges: int = TASK_EDGES, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); root is the smallest id.

    A task's edges shrink to the stars of its own components. With more edges
    than ``task_edges`` a node then meets its neighbours of all tasks (one from
    each at most), keeps the smallest and links the others to it, until there
    are no others; what is left are trees, whose nodes are hung on their roots
    by pointer jumping. Edges never leave the cluster, and each round's table is
    written to the shared folder. No edges: no rows. Loops and repeated edges
    change nothing.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("near"))
    for k in range(max_rounds):
        tasks = max(1, -(-now.count() // task_edges))
        stars = now.coalesce(tasks).mapInArrow(_contract, "node bigint, near bigint")
        last = f"star{k}"
        if tasks == 1:
            tree = scratch.keep(stars, last)
            return _with_roots(tree)
        tree = scratch.keep(stars.repartition("node").mapInArrow(_resolve, "node bigint, near bigint, more boolean"), last)
        if k:
            scratch.drop(f"star{k - 1}")
        if tree.where("more").isEmpty():
            break
        now = tree.select(F.greatest("node", "near").alias("node"), F.least("node", "near").alias("near"))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    tree = tree.select("node", "near")
    for k in range(max_rounds):
        up = tree.select(F.col("node").alias("near"), F.col("near").alias("above"))
        jumped = scratch.keep(tree.join(up, "near", "left").select("node", F.coalesce("above", "near").alias("near"), F.col("above").isNotNull().alias("moved")), f"jump{k}")
        scratch.drop(last)
        last, tree = f"jump{k}", jumped.select("node", "near")
        if jumped.where("moved").isEmpty():
            return _with_roots(tree)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _with_roots(tree: DataFrame) -> DataFrame:
    return tree.select("node", F.col("near").alias("root")).union(tree.select(F.col("near").alias("node"), F.col("near").alias("root")).distinct())
