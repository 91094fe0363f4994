"""Connected components by alternating large-star and small-star rounds.

Both rounds are a minimum per node (combined before the shuffle) joined back to
the edges; every round's edges are written to the shared folder.  Before the first
round each task replaces its edges by links to the least node they reach there.  Hot nodes are
left to adaptive execution's skew join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeledger.llm.common import cut_small, lean


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (a > b): links neighbours to the least of them."""
    if large:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("least"))
        linked = around.join(least, "a").where(F.col("b") > F.col("a"))
        linked = linked.select(F.col("b").alias("a"), F.least("a", "least").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("least"))
        linked = edges.join(least, "a").where(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        linked = linked.unionByName(least.select("a", F.col("least").alias("b")))
    return linked.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) of longs: node and root, the least node it reaches.

    Nodes without edges and roots themselves are not listed."""
    edges = edges.where(F.col("a") != F.col("b"))
    edges = cut_small(_forest(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).distinct())
    while True:
        # Done when every node hangs on one root and no root hangs on another.
        several = edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1)
        hanging = edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").limit(1)
        if several.isEmpty() and hanging.isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = cut_small(_star(_star(edges, large=True), large=False))


def _forest(edges: DataFrame) -> DataFrame:
    """The edges of a task's batches as links to the least node they reach there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, at = np.unique(np.concatenate([batch.column(0).to_numpy(), batch.column(1).to_numpy()]), return_inverse=True)
            i, j = at[: batch.num_rows], at[batch.num_rows :]
            linked, root = forest(i, j, len(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[root])], names=["a", "b"])

    return edges.mapInArrow(lean(run), "a long, b long")


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of each component but its least, and that least: star edges."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            break
    linked = np.flatnonzero(root != np.arange(n))
    return linked, root[linked]
