"""Readers of landed files.  Schemas are declared, never inferred."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a multi-line JSON array; an empty table if the path is not there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    if not there:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


#: Most frames kept read in a session; the one used longest ago makes room.
READ_FRAMES = 32


def memoised(spark: SparkSession, path: str, read: Callable[[str], DataFrame]) -> DataFrame:
    """``read(path)``, kept in its session while the path's time and size stay as they
    are; what has changed is read anew."""
    kept: dict[str, tuple[tuple, DataFrame]] = spark.__dict__.setdefault("_rangeledger_read", {})  # goes with the session
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    summary = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    mark = (summary.getFileStatus(hadoop).getModificationTime(), summary.getContentSummary(hadoop).getLength())
    had = kept.pop(path, None)
    if had is not None and had[0] != mark:
        had[1].unpersist()
        had = None
    kept[path] = had or (mark, read(path).persist())
    while len(kept) > READ_FRAMES:
        kept.pop(next(iter(kept)))[1].unpersist()
    return kept[path][1]


def symbol_directory(lines: DataFrame, column: str = "value") -> DataFrame:
    """Pipe-delimited symbol lists: symbol, name, exchange and the marks of funds and
    test issues where the list has them; header and footer are skipped."""
    cells = F.split(F.col(column), r"\|")
    rows = lines.where(F.contains(column, F.lit("|")) & ~F.col(column).startswith("File Creation Time") & ~F.lower(column).rlike(r"^(act )?symbol\|"))
    return rows.select(F.upper(F.trim(cells[0])).alias("ticker"), F.trim(cells[1]).alias("issuer_name"), F.nullif(F.trim(F.get(cells, F.lit(2))), F.lit("")).alias("exchange"),
        F.coalesce(F.trim(F.get(cells, F.lit(4))) == "Y", F.lit(False)).alias("is_etf"), F.coalesce(F.trim(F.get(cells, F.lit(3))) == "Y", F.lit(False)).alias("is_test")).where((F.col("ticker") != "") & (F.col("issuer_name") != ""))


def company_tickers(rows: DataFrame, column: str = "data") -> DataFrame:
    """From an array of [cik, name, ticker, exchange] arrays: one row each; rows of
    fewer than four cells or without ticker or name are left out."""
    one = rows.select(F.explode(column).alias("c")).where(F.size("c") >= 4)
    named = one.select(F.col("c")[0].try_cast("long").alias("cik"), F.trim(F.col("c")[1]).alias("issuer_name"), F.upper(F.trim(F.col("c")[2])).alias("ticker"), F.col("c")[3].alias("exchange"))
    return named.where((F.coalesce("ticker", F.lit("")) != "") & (F.coalesce("issuer_name", F.lit("")) != ""))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """Path, length and upper-case SHA-256 of files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.upper(F.sha2("content", 256)).alias("sha256"))

