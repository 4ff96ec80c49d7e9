"""Connected components of a graph of links: union-find in each batch, then alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm import _memory as M
from lanewise.llm._tables import cut


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node reachable by these links) for each node that isn't the least itself."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(index[: len(a)].tolist(), index[len(a) :].tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    roots = np.array([root(x) for x in range(len(nodes))], np.int64)
    moved = np.flatnonzero(roots != np.arange(len(nodes)))
    return nodes[moved], nodes[roots[moved]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, least = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.record_batch([pa.array(node), pa.array(least)], names=["u", "v"])


def _forest_of_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = list(batches)
    both = [np.concatenate([p.column(i).to_numpy() for p in parts] or [np.zeros(0, np.int64)]) for i in (0, 1)]
    node, least = forest(*both)
    yield pa.record_batch([pa.array(node), pa.array(least)], names=["node", "component"])


#: Links of forests up to which one task joins them; beyond, rounds of joins do.
ONE_TASK = 400_000


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component): the least node reachable, for every node of links (a, b: bigint) but the
    least ones themselves.

    Each Arrow batch of links first shrinks to a forest. If no more than ``one_task`` links are left
    in all, a single task joins them. Otherwise rounds hang every node's larger
    neighbours, and after that its smaller ones, on its least neighbour, until nothing changes:
    then each component is a star. The rounds are joins and grouped minima, written to the shared
    checkpoint folder; their number grows with the logarithm of the longest path.

    Null ends, loops and repeated links are ignored; no links give no rows.
    """
    ends = links.toDF("a", "b").filter("a is not null and b is not null and a <> b")
    edges = cut(ends.mapInArrow(M.batches(_forests), "u bigint, v bigint").distinct())
    if edges.count() <= one_task:
        return edges.repartition(1).mapInArrow(M.batches(_forest_of_all), "node bigint, component bigint")
    state = None
    while True:
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if (seen.n, seen.s) == state or not seen.n:
            return edges.toDF("node", "component")
        state = (seen.n, seen.s)
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", F.col("m").alias("v")))
        edges = cut(small.distinct())
