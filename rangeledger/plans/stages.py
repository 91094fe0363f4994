"""Results written once and read by several plans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see: the cluster's checkpoint folder.

    Local mode makes one where none is configured; a cluster gets an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


_FOLDER: ContextVar[str | None] = ContextVar("stages", default=None)


@contextmanager
def stages(spark: SparkSession) -> Iterator[str]:
    """A scope whose stages are tables of one folder, which goes at its end: what is
    planned inside is to be written or collected inside."""
    folder = scratch(spark, "stages")
    token = _FOLDER.set(folder)
    try:
        yield folder
    finally:
        _FOLDER.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, its lineage cut; what reads it twice plans from there."""
    folder = _FOLDER.get()
    if folder is None:
        shared_dir(df.sparkSession)
        return df.checkpoint()
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Parts(Mapping[str, DataFrame]):
    """Results by name, each planned when it is first taken: who asks for one pays for
    that one, and what it needs of the others is planned once."""

    def __init__(self, **makers: Callable[[], DataFrame]) -> None:
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)
