"""Vectors as blocks of whole numbers, kept in tables of the shared folder.

A block is a bounded number of rows of one task's split: nothing is shuffled to
make it, and copies or hot labels do not gather anywhere."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeledger.llm.text import slices

BLOCK_ROWS = 2048
LONG = (-(2**63), 2**63 - 1)


def all_finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are there and finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def component_limit(dims: int) -> int:
    """Largest whole component with which squared distances of two vectors fit a long."""
    return int((2**62 / max(1, dims)) ** 0.5 / 2)


def whole(rows: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of float64 rows, held to the component limit."""
    limit = component_limit(rows.shape[1])
    with np.errstate(over="ignore"):
        return np.clip(np.floor(rows * scale), -limit, limit).astype(np.int64)


def narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest type that holds them."""
    top = int(np.abs(x).max(initial=0))
    return x.astype(np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.int64)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), dims)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    return (part for part in slices(batches, rows) if part.num_rows)


def packed(value: object) -> bytes:
    return pickle.dumps(value, protocol=5)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def held_long(value: int) -> int:
    return max(LONG[0], min(LONG[1], value))


def first_vectors(rows: DataFrame, order: list[Column], n: int) -> list[list[float]]:
    """The first n vectors in the given order, then in that of their components."""
    return [list(r[0]) for r in rows.orderBy(*order, "vector").limit(n).select("vector").collect()]
