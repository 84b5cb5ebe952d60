"""Connected components by alternating star contraction of the spanning forests of each partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


SLICE = 200_000


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b) and for each the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while len(u):
        pu, pv = parent[u], parent[v]
        open_ = pu != pv
        u, v, pu, pv = u[open_], v[open_], pu[open_], pv[open_]
        if not len(u):
            break
        np.minimum.at(parent, np.maximum(pu, pv), np.minimum(pu, pv))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return nodes, nodes[parent]


def local_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spanning forest of a partition of edges (a, b) as stars (node, root), roots included.

    Holds no more than the forest and one slice of edges at a time.
    """
    node, root = np.empty(0, "int64"), np.empty(0, "int64")
    pending: list[pd.DataFrame] = []
    waiting = 0
    for batch in batches:
        pending.append(batch)
        waiting += len(batch)
        if waiting > max(SLICE, len(node)):
            node, root = union_find(np.concatenate([node, *[p["a"].to_numpy() for p in pending]]), np.concatenate([root, *[p["b"].to_numpy() for p in pending]]))
            pending, waiting = [], 0
    if waiting:
        node, root = union_find(np.concatenate([node, *[p["a"].to_numpy() for p in pending]]), np.concatenate([root, *[p["b"].to_numpy() for p in pending]]))
    for i in range(0, len(node), SLICE):
        yield pd.DataFrame({"node": node[i : i + SLICE], "root": root[i : i + SLICE]})


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the node's smallest neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is hung on the smallest of them; edges point down."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, head) of every node of ``edges`` (a, b); head is the smallest id of its component.

    Each partition keeps only its spanning forest; what is left shrinks to stars in logarithmically many rounds. Minima combine before each
    shuffle, and joins on a busy node are split by adaptive execution. Null ends and loops join nothing.
    """
    stars = edges.where(F.col("a") != F.col("b")).select(F.col("a").cast("long"), F.col("b").cast("long")).mapInPandas(local_forest, "node long, root long")
    now, before = cut(stars.where(F.col("node") != F.col("root")).select(F.col("node").alias("u"), F.col("root").alias("v")).distinct()), None
    while True:
        now = cut(_small_star(_large_star(now).where(F.col("u") != F.col("v"))).distinct())
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        if mark == before:
            break
        before = mark
    return now.select(F.col("u").alias("id"), F.col("v").alias("head")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("head")).distinct())
