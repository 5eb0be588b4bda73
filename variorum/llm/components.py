"""Connected components of a distributed edge list.

Parts of at most `PART` edges are contracted in memory, each by itself: an edge list becomes stars around the smallest node
that a part knows. A graph of one part is done then; of a larger one, alternating large and small stars join the parts' stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variorum.llm import bytesops as B
from variorum.llm import storage

#: Edges (of 16 bytes) that one task contracts.
PART = 500_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of all nodes but the smallest ones."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        for end in (root[a], root[b]):
            np.minimum.at(root, end, low)
        while (further := root[root]).tobytes() != root.tobytes():
            root = further
        if (root == before).all():
            moved = root != np.arange(len(nodes))
            return nodes[moved], nodes[root[moved]]


def _contracted(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if held:
            node, root = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["u", "v"])

    return edges.mapInArrow(B.task(run), "u long, v long")


def components(edges: DataFrame, name: str = "components", part: int = PART) -> DataFrame:
    """node and root (the component's smallest node) of all nodes that aren't roots; edges: u, v of type long.

    Every round is written to the shared folder; only its number of edges and a checksum come to the driver.
    """
    now = storage.kept(edges.select("u", "v").where("u <> v").distinct(), name)
    parts = -(-now.count() // part)
    now = storage.kept(_contracted(now.coalesce(1) if parts <= 1 else now.repartition(parts)), name)
    before = None
    while parts > 1:
        now = storage.kept(_small_star(_large_star(now)), name)
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).head())
        if mark == before:
            break
        before = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
