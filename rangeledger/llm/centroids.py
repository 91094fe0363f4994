"""Centroid clustering with an incremental distance matrix.

Each vector keeps its exact integer dot product with every centroid, in blocks of
a table in the shared folder.  When a centroid moves, only the components that
have changed are multiplied again: the dot products grow by x times the change.
The squared distance is |x|^2 - 2 x.c + |c|^2, its least gives the cluster.  A
round reads the last table, writes the next one and adds up sums and counts per
block; Spark adds those, so that the driver sees k rows of components, however
many vectors there are.  The table before the last is deleted.

Components become floor(scale * x).  Defined cases: vectors that are null, have
another length than ``dims`` or a null or non-finite component take no part; rows
without an id take part, last in the order of the first centroids; rows that
share an id are vectors of their own, in order of components; fewer than k
vectors give as many centroids; an empty table gives no rows; components so
large that squared distances would not fit a long (2**27 after scaling, at 64
components) are held to that limit.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeledger.llm import blocks
from rangeledger.llm.common import scratch

STATE = "payload binary, sums array<decimal(38,0)>"
SUMS = pa.list_(pa.decimal128(38, 0))


@dataclass
class Clustering:
    """Rows (id, cluster, distance) and what was learnt."""

    rows: DataFrame
    centroids: list[list[int]]
    counts: list[int]
    inertias: list[int]

    @property
    def inertia(self) -> int:
        return sum(self.inertias)


def digest(numbers: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def moved(block: dict, before: np.ndarray, after: np.ndarray) -> None:
    """Bring a block's dot products from the old centroids to the new ones."""
    x = block["x"]
    for n, change in enumerate(after - before):
        at = np.flatnonzero(change)
        if len(at):
            block["dots"][:, n] += x[:, at].astype(np.int64) @ change[at]


def assigned(block: dict, centroids: np.ndarray) -> list[int]:
    """Set cluster and distance of a block's vectors; per centroid count, distance
    and component sums, one after the other."""
    k = len(centroids)
    distance = block["norm"][:, None] - 2 * block["dots"] + (centroids * centroids).sum(axis=1)[None, :]
    block["cluster"] = distance.argmin(axis=1).astype(np.int32)
    block["distance"] = distance[np.arange(len(distance)), block["cluster"]]
    mine = block["cluster"][None, :] == np.arange(k)[:, None]
    sums = mine.astype(np.int64) @ block["x"].astype(np.int64)
    out: list[int] = []
    for n in range(k):
        out += [int(mine[n].sum()), sum(block["distance"][mine[n]].tolist()), *sums[n].tolist()]
    return out


def _row(block: dict, sums: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([blocks.packed(block)], pa.binary()), pa.array([list(map(Decimal, sums))], SUMS)], names=["payload", "sums"])


def _first(scale: float, dims: int, centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks.pieces(batches):
            x = blocks.whole(blocks.matrix(part.column(1), dims), scale)
            block = {"ids": part.column(0).to_pylist(), "x": blocks.narrow(x), "norm": (x * x).sum(axis=1), "dots": np.zeros((len(x), len(centroids)), dtype=np.int64)}
            moved(block, np.zeros_like(centroids), centroids)
            yield _row(block, assigned(block, centroids))

    return run


def _next(before: np.ndarray, after: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks.pieces(batches, 1):
            block = pickle.loads(part.column(0)[0].as_py())
            moved(block, before, after)
            yield _row(block, assigned(block, after))

    return run


def _unpacked(id_type: pa.DataType, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks.pieces(batches, 1):
            block = pickle.loads(part.column(0)[0].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(block["ids"], id_type), pa.array(block["cluster"], pa.int32()), pa.array(block["distance"], pa.int64())], names=names)

    return run


def _totals(spark: SparkSession, path: str, k: int, dims: int) -> list[list[int]]:
    """Per centroid its count, distance and component sums over all blocks."""
    each = spark.read.schema(STATE).parquet(path).select(F.posexplode("sums").alias("at", "value"))
    found = {r["at"]: int(r["total"]) for r in each.groupBy("at").agg(F.sum("value").alias("total")).collect()}  # k * (dims + 2) rows
    return [[found.get(n * (dims + 2) + i, 0) for i in range(dims + 2)] for n in range(k)]


def cluster_vectors(
    vectors: DataFrame, first: Column, k: int = 8, rounds: int = 10, dims: int = 64, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding"
) -> Clustering:
    """Lloyd's rounds over all vectors; the first centroids are the k first by ``first``
    (an expression on the id column)."""
    spark = vectors.sparkSession
    kept = vectors.where(blocks.all_finite(F.col(vector_col)) & (F.size(vector_col) == dims))
    kept = kept.select(F.col(id_col), F.col(vector_col).cast("array<double>").alias("vector"), first.alias("first"))
    chosen = blocks.first_vectors(kept, [F.col("first").asc_nulls_last()], k)
    id_field = vectors.schema[id_col]
    schema = T.StructType([id_field, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not chosen:
        return Clustering(spark.createDataFrame([], schema), [], [], [])
    centroids = blocks.whole(np.array(chosen, dtype=np.float64), scale)
    step, source, state = _first(scale, dims, centroids), kept.select(id_col, "vector"), None
    for left in range(rounds, -1, -1):
        path = scratch(spark, "distance-matrix")
        source.mapInArrow(step, STATE).write.parquet(path)
        if state is not None:
            blocks.forget(spark, state)
        state, totals = path, _totals(spark, path, len(centroids), dims)
        after = np.array([[s // t[0] for s in t[2:]] if t[0] else c.tolist() for t, c in zip(totals, centroids, strict=True)], dtype=np.int64)
        if not left or (after == centroids).all():  # nothing moves: later rounds would give the same
            break
        step, source, centroids = _next(centroids, after), spark.read.schema(STATE).parquet(state), after
    from pyspark.sql.pandas.types import to_arrow_type

    rows = spark.read.schema(STATE).parquet(state).select("payload").mapInArrow(_unpacked(to_arrow_type(id_field.dataType), schema.fieldNames()), schema)
    return Clustering(rows, centroids.tolist(), [t[0] for t in totals], [t[1] for t in totals])


def with_cluster_facts(found: Clustering) -> DataFrame:
    """Each row with its cluster's inertia, that of all, and its centroid's digest."""
    if not found.centroids:
        return found.rows.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    # k values of fixed size.
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    inertias = [blocks.held_long(v) for v in found.inertias]
    return found.rows.select("*", of(inertias).cast("long").alias("cluster_inertia"), F.lit(blocks.held_long(found.inertia)).cast("long").alias("inertia"), of([digest(c) for c in found.centroids]).alias("centroid_sha256"))
