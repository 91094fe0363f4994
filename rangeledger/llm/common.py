"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import inspect
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Words of a text: runs of bytes other than the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Most bytes of a side that is broadcast, as estimated from its columns; larger sides are joined by shuffle.
BROADCAST_BYTES = 8 << 20
#: Most rows of whole texts that go to a Python worker at once.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see: the cluster's checkpoint folder.

    Where none is configured, local mode makes a folder of its own (driver and
    tasks are one machine); a cluster gets an error rather than local folders."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, with its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def cut_small(df: DataFrame) -> DataFrame:
    """:func:`cut` for rows of ids and counts: at most as many files as the cluster
    has cores, since a file costs more than such rows do."""
    return cut(df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism)))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def give_back_memory() -> None:
    """Return what a worker has freed to the system: workers stay for later tasks, and
    what they keep stands beside those of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def lean(fn: Callable) -> Callable:
    """A task's function of one argument, or generator, that gives its memory back when it ends."""
    if inspect.isgeneratorfunction(fn):

        @functools.wraps(fn)
        def generate(batches):
            try:
                yield from fn(batches)
            finally:
                give_back_memory()

        return generate

    @functools.wraps(fn)
    def run(data):
        try:
            return fn(data)
        finally:
            give_back_memory()

    return run


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches held to ``BATCH_ROWS`` rows: a batch
    of whole texts stands in memory in the JVM and in the worker."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def broadcast_rows(schema: T.StructType) -> int:
    """Rows of the schema that ``BROADCAST_BYTES`` hold; columns without a fixed
    width count 256 bytes (keys written as text are far shorter)."""
    widths = {T.LongType: 8, T.IntegerType: 4, T.DoubleType: 8, T.BooleanType: 1, T.DateType: 4, T.StringType: 64}
    return BROADCAST_BYTES // (16 + sum(widths.get(type(f.dataType), 256) for f in schema.fields))


def join_bounded(left: DataFrame, right: DataFrame, on, how: str = "inner", rows: int | None = None) -> DataFrame:
    """Join with ``right`` broadcast only if its counted rows fit the bound.

    ``right`` should be cheap to count (a checkpointed aggregate).  Beyond the
    bound the join shuffles, and adaptive execution splits skewed keys."""
    most = broadcast_rows(right.schema) if rows is None else rows
    small = right.limit(most + 1).count() <= most
    return left.join(F.broadcast(right) if small else right, on, how)


def add_columns(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(n, t) for n, t in fields)])


def with_row_numbers(df: DataFrame, *order: Column, value: str | None = None) -> tuple[DataFrame, int]:
    """``df`` with ``row_no`` (from 0 in the given order), and its row count.

    Rows are dealt by range and sorted within their range; the sorted rows are
    written once, so their numbers stay the same whatever is recomputed later.
    Only one count per range is summed in one place.  Rows equal in ``order``
    are interchangeable and numbered by their place in the input."""
    keyed = df.withColumn("_tie", F.monotonically_increasing_id())
    order = (*order, F.col("_tie").asc())
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    placed = cut(placed.withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    # One row per range partition: the number of partitions bounds the broadcast.
    numbered = placed.join(F.broadcast(offsets), "_part").withColumn("row_no", F.col("_before") + F.col("_at"))
    return numbered.drop("_part", "_at", "_n", "_before"), int(total)
