"""Writers: versioned tables, upserts, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeledger.plans.joins import priority_union


def upserted(current: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``current`` with the rows of ``new`` in place of those of the same key."""
    return priority_union(key, new, current)


def flat_sheet(df: DataFrame) -> DataFrame:
    """Arrays joined by '; ' and structs spread, as a sheet of plain cells."""
    cells = []
    for field in df.schema.fields:
        if isinstance(field.dataType, T.ArrayType):
            cells.append(F.array_join(F.transform(field.name, lambda x: x.cast("string")), "; ").alias(field.name))
        elif isinstance(field.dataType, T.StructType):
            cells += [F.col(f"{field.name}.{n}").alias(f"{field.name}_{n}") for n in field.dataType.names]
        else:
            cells.append(F.col(field.name))
    return df.select(*cells)


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """One CSV folder per sheet."""
    for name, df in sheets.items():
        flat_sheet(df).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
