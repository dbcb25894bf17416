"""Connected components of an edge table, by stars that are drawn together until they rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import arrays as A

#: About so many edges are one task of a round, and are drawn together at once.
EDGES = 250_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect the same nodes as the edges: each node but the smallest of its component, and that smallest."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        a, b = a[open_ := root[a] != root[b]], b[open_]
    leaf = root != np.arange(len(nodes))
    return nodes[leaf], nodes[root[leaf]]


def _drawn(edges: DataFrame) -> DataFrame:
    """The edges of each task, or of each run of ``EDGES`` of them, as stars."""

    def drawn(have: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        u, v = _stars(*map(np.concatenate, zip(*have, strict=True)))
        return pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, n = [], 0
        for batch in batches:
            have.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
            n += batch.num_rows
            if n >= EDGES:
                yield drawn(have)
                have, n = [], 0
        if n:
            yield drawn(have)

    return edges.mapInArrow(draw, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node with an edge; the component is its smallest node.

    Tasks first draw their own edges together.  Each round runs over the edges only, in as many tasks as there are runs of
    ``EDGES`` edges, and is checkpointed; rounds grow with the logarithm of the diameter.
    """
    edges = edges.toDF("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = A.stored(_drawn(edges))
    n = edges.count()
    while True:
        tasks = max(1, -(-n // EDGES))
        edges = A.checkpointed(_drawn(edges.distinct().coalesce(tasks)))
        # at rest every node has one star, and its middle no other
        of = edges.union(edges.selectExpr("v", "v")).toDF("node", "component")
        of = of.groupBy("node").agg(F.min("component").alias("component"), F.max("component").alias("other"))
        of = A.checkpointed(of.coalesce(tasks))
        if of.where("component < other").isEmpty():
            return of.select("node", "component")
        n = edges.count()
        edges = _small_star(_large_star(edges).distinct())
