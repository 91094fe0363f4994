"""Reproducible shuffle into shards by a Feistel permutation.

Documents get global row numbers in ``doc_id`` order.  A keyed Feistel network
over ``left x right`` cells, walked until it falls below the number of rows,
permutes the numbers; the permuted number gives shard (remainder) and slot
(quotient) by arithmetic alone, so any place can be computed without a shuffle
and ``original_row`` inverts it.  Shards differ by one row at most.

Defined cases: a null text counts as no bytes; null ids are numbered last;
repeated rows each get a place of their own; an empty table gives no rows;
columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeledger.llm.common import with_row_numbers

ROUNDS = 6
#: Bytes a stored record needs besides its text.
RECORD_BYTES = 16


def _grid(rows: int) -> tuple[int, int]:
    left = max(1, math.isqrt(max(rows - 1, 0)) + 1)
    return left, max(1, -(-rows // left))


def _rounds(x: str, rows: int, key: int, back: bool) -> str:
    left, right = _grid(rows)
    sign = "-" if back else "+"
    steps = ", ".join(str(i) for i in (reversed(range(ROUNDS)) if back else range(ROUNDS)))
    turn_l = f"pmod(s.l {sign} pmod(xxhash64(s.r, i, {key}L), {left}L), {left}L)"
    turn_r = f"pmod(s.r {sign} pmod(xxhash64(s.l, i, {key}L), {right}L), {right}L)"
    return (
        f"aggregate(array({steps}), named_struct('l', {x} div {right}L, 'r', {x} % {right}L), "
        f"(s, i) -> if(i % 2 = 0, named_struct('l', {turn_l}, 'r', s.r), named_struct('l', s.l, 'r', {turn_r})), "
        f"s -> s.l * {right}L + s.r)"
    )


def _walk(x: str, rows: int, key: int, back: bool) -> Column:
    """The permutation of ``x``; outside cells are walked through.

    Each walk passes every one of the ``left * right - rows`` outside cells at
    most once, which bounds its length on small tables; on large ones fewer
    than one cell in ``sqrt(rows)`` is outside, and 64 steps never run out (it
    would be an error, not a wrong place)."""
    left, right = _grid(rows)
    steps = min(left * right - rows, 64)
    once = _rounds(x, rows, key, back)
    if not steps:
        return F.expr(once)
    again = _rounds("y", rows, key, back)
    found = f"if(y < {rows}L, y, cast(raise_error('the walk did not end') as bigint))"
    walked = f"aggregate(sequence(1, {steps}), {once}, (y, k) -> if(y < {rows}L, y, {again}), y -> {found})"
    return F.expr(walked)


def permuted_row(row: str, rows: int, key: int = 0) -> Column:
    """Place of global row ``row`` (a column name) among ``rows``."""
    return _walk(row, rows, key, back=False)


def original_row(place: str, rows: int, key: int = 0) -> Column:
    """Inverse of :func:`permuted_row`: which row stands at ``place``."""
    return _walk(place, rows, key, back=True)


def _placed(docs: DataFrame, shards: int, key: int, *more: Column) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    light = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(RECORD_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *more,
    )
    numbered, rows = with_row_numbers(light, F.col("doc_id").asc_nulls_last(), F.col("text_crc32").asc(), F.col("size").asc())
    placed = numbered.withColumn("place", permuted_row("row_no", rows, key) if rows else F.lit(0).cast("long"))
    return placed.withColumns({"shard": (F.col("place") % shards).cast("int"), "slot": F.expr(f"place div {shards}")})


def shard_documents(docs: DataFrame, shards: int, key: int = 0) -> DataFrame:
    """Per document: doc_id, size, text_crc32, row_no, place, shard, slot."""
    return _placed(docs, shards, key)


def write_shards(docs: DataFrame, path: str, shards: int, key: int = 0) -> None:
    """Write the documents as one folder per shard, ordered by slot.

    Whole rows are numbered, so rows that share an id keep places of their own;
    columns ``shard`` and ``slot`` of the input are replaced."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot"))).alias("_row")
    full = _placed(docs, shards, key, whole).select("_row.*", "shard", "slot")
    full.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
