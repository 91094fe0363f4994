"""Dealing vectors into shards and query blocks, and merging their finds.

A search is laid out as cells (shard of candidates x block of queries).  Both
have a bounded number of rows, dealt by a hash of the id, so that no hot vector
or key makes a large cell.  The stated query set meets all shards in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rangeledger.llm.text import slices

MAX_TASKS = 20_000


def finite_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vector, dim of the rows that take part: an id, and a vector whose
    components are all there and finite."""
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.size(vector_col).alias("dim")
    )


def parts(rows: int, each: int) -> int:
    return max(1, -(-rows // each))


def dealt(n: int, salt: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")


def cells(packed: DataFrame, queries: DataFrame, shards: int, block_rows: int, fn: Callable, schema: str) -> DataFrame:
    """``fn(packed shard, query rows)`` for every shard and block of queries; one row per
    shard in ``packed``, one query row per id and dim.

    A shard stays where it is and the queries are brought to it, in order behind its
    row: a task holds one shard and one block of queries at a time."""
    tile = next(c for c in packed.columns if c not in ("dim", "shard"))
    own = [c for c in queries.columns if c != "dim"]
    none = lambda c: F.lit(None).cast(queries.schema[c].dataType).alias(c)
    left = packed.select("dim", "shard", F.lit(0).alias("part"), F.col(tile).alias("packed"), *(none(c) for c in own))
    asked = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = asked.select("dim", "shard", F.lit(1).alias("part"), F.lit(None).cast("binary").alias("packed"), *own)
    placed = left.unionByName(right).repartition(min(shards, MAX_TASKS), "dim", "shard").sortWithinPartitions("dim", "shard", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in slices(batches, block_rows):
            rows = batch.to_pandas()
            for (dim, shard, part), some in rows.groupby(["dim", "shard", "part"], sort=True):
                if part == 0:
                    at, held = (dim, shard), some[["packed"]].rename(columns={"packed": tile})
                elif at == (dim, shard):
                    yield pa.RecordBatch.from_pandas(fn(held, some[own]), preserve_index=False)

    return placed.mapInArrow(run, schema)


def one_query_per_id(queries: DataFrame) -> DataFrame:
    """Of rows sharing an id and a length, the least vector."""
    return queries.groupBy("id", "dim").agg(F.min("vector").alias("vector"))


def best(found: DataFrame, k: int) -> DataFrame:
    """The k rows of highest score per query, ties to the smaller id, with rank."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def one_per_id(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """ids ascending and their vectors as rows; of rows sharing an id, the least vector."""
    ids = pdf["id"].to_numpy(np.int64)
    rows = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["vector"]]) if len(ids) else np.zeros((0, 0))
    order = np.lexsort((*rows.T[::-1], ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
    ids, rows = ids[order], rows[order]
    first = np.concatenate([[True], ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, bool)
    return ids[first], rows[first]


def fewest_copies(ids: np.ndarray, rows: np.ndarray, keep: int) -> np.ndarray:
    """Indices of the ``keep`` smallest ids of each distinct row.  Copies score
    alike and ties go to smaller ids, so no other copy can be among the best
    ``keep - 1`` besides the query itself."""
    if rows.shape[1] == 0:
        return np.arange(min(len(ids), keep))
    _, group = np.unique(rows, axis=0, return_inverse=True)
    group = group.reshape(-1)
    order = np.argsort(group, kind="stable")  # ids ascend within a group
    starts = np.concatenate([[0], np.flatnonzero(np.diff(group[order])) + 1])
    nth = np.arange(len(order)) - np.repeat(starts, np.diff([*starts, len(order)]))
    return np.sort(order[nth < keep])


def in_blocks(n: int, size: int) -> Iterator[slice]:
    return (slice(i, i + size) for i in range(0, n, size))
