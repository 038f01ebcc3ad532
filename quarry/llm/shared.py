"""What several operators share: components of edges found in tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.components import connected, cut

__all__ = ["components", "cut", "forest"]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes of the edges a-b that aren't it themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        low = np.minimum(parent[x], parent[y])
        before = parent.copy()
        np.minimum.at(parent, parent[x], low)
        np.minimum.at(parent, parent[y], low)
        np.minimum.at(parent, x, low)
        np.minimum.at(parent, y, low)
        while True:
            jumped = parent[parent]
            if (jumped == parent).all():
                break
            parent = jumped
        if (parent == before).all():
            break
    own = parent != np.arange(len(nodes))
    return nodes[own], nodes[parent[own]]


def _local_forests(batches):
    """Edges (u, v) of a partition as stars around the smallest node, merged as batches come."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= 1_000_000:
            x, y = forest(*(np.concatenate([p, *(r.column(i).to_numpy() for r in held)]) for i, p in enumerate((a, b))))
            held, size = [], 0
            if len(x) > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["u", "v"])
                x = y = np.zeros(0, np.int64)
            a, b = x, y
    if held or len(a):
        x, y = forest(*(np.concatenate([p, *(r.column(i).to_numpy() for r in held)]) for i, p in enumerate((a, b))))
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes of edges (u, v), both long: component is the smallest id reachable.

    Each task first contracts its own edges to stars around their smallest nodes, which is all that
    the rounds over all tasks then see. Self-loops and repeated edges are allowed; null ends are dropped.
    """
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")
    return connected(e.mapInArrow(_local_forests, "u long, v long"))
