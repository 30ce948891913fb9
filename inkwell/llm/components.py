"""Connected components of an edge table: in one task if it is small, else by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import keep

FEW = 1 << 20  # edges, of 16 bytes each


def _least(edges: DataFrame) -> DataFrame:
    """(u, v) edges -> (u, v, m), m the least of u and its neighbours; a hot u is aggregated before the shuffle."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
    return edges.join(low, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = _least(down)
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, root) of all edges, by union and find on the nodes' places in order, so that the least is the root."""
    u, v = (np.concatenate(c) for c in zip(*[(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches], strict=True))
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in zip(place[: len(u)].tolist(), place[len(u) :].tolist(), strict=True):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    root = np.array([find(x) for x in range(len(nodes))])
    other = root != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[root[other]])], ["u", "root"])


def components(edges: DataFrame) -> DataFrame:
    """Edges (u long, v long) -> (u, root), root the least node reachable; nodes without an edge to another are left out.

    Up to FEW distinct edges, which is counted, are joined up in one task. For more, every step is a groupBy with partial
    aggregation and a join on the node, so no component meets in one task, and only a fingerprint of the edge table
    (count and hash sum) comes to the driver. Both give the same.
    """
    now = keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    n = now.count()
    if n == 0:
        return now.select("u", F.col("v").alias("root"))
    if n <= FEW:
        return keep(now.repartition(1).mapInArrow(_in_one_task, "u long, root long"))
    before = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == before:
            return now.select("u", F.col("v").alias("root"))
        before = mark
        now = keep(_small_star(_large_star(now)))
