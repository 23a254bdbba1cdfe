"""Connected components of links: union-find within partitions, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage, tidied, unstage


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links, and the smallest node of each one's component."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    parent = list(range(len(nodes)))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        parent[max(x, y)] = min(x, y)
    for x in range(len(parent)):  # parents are smaller
        parent[x] = parent[parent[x]]
    return nodes, nodes[np.array(parent, dtype=np.int64)] if len(nodes) else nodes


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's links as a star for each of its components."""
    for batch in batches:
        nodes, roots = union_find(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False))
        keep = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep], pa.int64()), pa.array(roots[keep], pa.int64())], ["u", "v"])


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of each node that has links; the root is the component's smallest node. Null ends are ignored.

    Minima are combined before the shuffle and joined back to the links, so a hub's links are never gathered in one task.
    """
    small_batches(links.sparkSession)
    edges = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u > v")
    edges = stage(edges.mapInArrow(tidied(_contract), "u long, v long").distinct(), "links")
    before = None
    while True:
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            out = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
            out.staged_at = edges.staged_at  # what it reads, for the caller to unstage
            return out
        before = state
        # large star: each node's larger neighbours to its smallest neighbour
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # small star: each node and its smaller neighbours to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        old, edges = edges, stage(small.where("u > v").distinct(), "links")
        unstage(old)
