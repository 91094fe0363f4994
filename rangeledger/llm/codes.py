"""Vector code compression: product codes learnt by Lloyd's rounds over cover trees.

Vectors are cut into equal consecutive parts, each with a codebook.  Every block
of a task's rows gets, per part, a cover tree over its distinct points: a node's
children lie within half its radius of centres that are farther than that from
each other; nodes carry weight and component sums of all below.  A round walks
the trees level by level.  A node whose nearest entry stays nearest for all
within its radius (triangle inequality) gives its whole weight and sum to that
entry; only the others go down to their children, and in the end to exact
integer comparisons of points, ties to the lower entry.  Trees are built once and
kept in the shared folder; a task returns one sum per part and entry.

Components become floor(scale * x), entries floor(sum / count).  Defined cases:
vectors that are null or have a null or non-finite component are dropped; of the
others those whose length is not that of the first (smallest id) take no part;
where the length is no multiple of the parts, the first parts are one longer, a
part without components has code 0; rows without an id take part, last in the
order of the first entries; fewer vectors than entries give as many entries; an
empty table gives no rows; components are held to the limit at which squared
distances fit a long.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeledger.llm import blocks
from rangeledger.llm.common import cut, join_bounded, scratch

LEAF_POINTS = 12
#: Rounding of the double-precision square roots that bounds are made of.
SLACK = 1e-9


@dataclass
class Codes:
    """Rows (id, label, code, error) and the final codebooks, by part and entry."""

    rows: DataFrame
    books: list[list[list[int]]]


def squares(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points from all entries."""
    out = np.zeros((len(points), len(book)), dtype=np.int64)
    for i in range(points.shape[1]):
        away = points[:, i, None].astype(np.int64) - book[None, :, i]
        out += away * away
    return out


def cover_tree(points: np.ndarray, weight: np.ndarray) -> dict:
    """Tree over distinct points; nodes list their range of the points' new order."""
    order, nodes, sizes = np.arange(len(points)), [], []  # nodes: start, end, first child, last child, centre
    wide = points.astype(np.int64)
    todo = [(0, len(points), 0)]
    for at, (start, end, centre) in enumerate(todo):  # grows while it is read
        rest = order[start:end].copy()
        away = np.sqrt(((wide[rest] - wide[centre]) ** 2).sum(axis=1).astype(np.float64))
        radius = float(away.max(initial=0.0))
        nodes.append([start, end, 0, 0, centre])
        sizes.append(radius)
        if end - start <= LEAF_POINTS or radius == 0:
            continue
        nodes[at][2] = len(todo)
        put, pivot = start, centre
        while len(rest):
            near = away <= radius / 2
            some = rest[near]
            order[put : put + len(some)] = some
            todo.append((put, put + len(some), pivot))
            put, rest = put + len(some), rest[~near]
            if len(rest):
                pivot = rest[0]
                away = np.sqrt(((wide[rest] - wide[pivot]) ** 2).sum(axis=1).astype(np.float64))
        nodes[at][3] = len(todo)
    table = np.array(nodes, dtype=np.int32)
    total = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(wide[order] * weight[order, None], axis=0)])
    count = np.concatenate([[0], np.cumsum(weight[order])])
    start, end = table[:, 0], table[:, 1]
    return {"points": points[order], "weight": weight[order], "order": order, "nodes": table[:, :4], "centres": points[table[:, 4]], "radii": np.array(sizes), "sums": total[end] - total[start], "counts": count[end] - count[start]}


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the given ranges, one range after the other."""
    size = end - start
    before = np.cumsum(size) - size
    return np.arange(size.sum()) + np.repeat(start - before, size)


def walk(tree: dict, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entry of each point (in the tree's order), weight and sum of each
    entry, and how many points had to be compared one by one."""
    label = np.zeros(len(tree["points"]), dtype=np.int32)
    count, total, compared = np.zeros(len(book), dtype=np.int64), np.zeros(book.shape, dtype=np.int64), 0
    level = np.zeros(1, dtype=np.int64)
    while len(level):
        square = squares(tree["centres"][level], book)
        best = square.argmin(axis=1)
        radius = tree["radii"][level]
        if len(book) > 1:
            two = np.sqrt(np.partition(square, 1, axis=1)[:, :2].astype(np.float64))
            settled = (two[:, 0] + 2 * radius) * (1 + SLACK) + SLACK < two[:, 1] * (1 - SLACK)
        else:
            settled = np.ones(len(level), dtype=bool)
        settled |= radius == 0
        node = tree["nodes"][level]
        done = node[settled]
        label[_ranges(done[:, 0], done[:, 1])] = np.repeat(best[settled], done[:, 1] - done[:, 0])
        np.add.at(count, best[settled], tree["counts"][level[settled]])
        np.add.at(total, best[settled], tree["sums"][level[settled]])
        open_ = node[~settled]
        leaf = open_[open_[:, 3] == 0]
        at = _ranges(leaf[:, 0], leaf[:, 1])
        if len(at):
            compared += len(at)
            near = squares(tree["points"][at], book).argmin(axis=1)
            label[at] = near
            np.add.at(count, near, tree["weight"][at])
            np.add.at(total, near, tree["points"][at].astype(np.int64) * tree["weight"][at, None])
        inner = open_[open_[:, 3] > 0]
        level = _ranges(inner[:, 2], inner[:, 3])
    return label, count, total, compared


def _cuts(dims: int, parts: int) -> list[slice]:
    edges = np.cumsum([0, *(len(p) for p in np.array_split(np.arange(dims), parts))])
    return [slice(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _builder(scale: float, dims: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in blocks.pieces(batches):
            x = blocks.narrow(blocks.whole(blocks.matrix(piece.column(2), dims), scale))
            trees = []
            for part in _cuts(dims, parts):
                if part.start == part.stop:
                    trees.append(None)
                    continue
                points, where, weight = np.unique(x[:, part], axis=0, return_inverse=True, return_counts=True)
                tree = cover_tree(points, weight.astype(np.int64))
                place = np.empty(len(points), dtype=np.int32)
                place[tree.pop("order")] = np.arange(len(points))
                trees.append(tree | {"where": place[where.reshape(-1)]})
            block = {"ids": piece.column(0).to_pylist(), "labels": piece.column(1).to_pylist(), "trees": trees}
            yield pa.RecordBatch.from_arrays([pa.array([blocks.packed(block)], pa.binary())], names=["payload"])

    return run


def _summer(books: list[np.ndarray]):
    """One row per part and entry of a task: weight and component sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = [np.zeros(len(b), np.int64) for b in books], [np.zeros(b.shape, np.int64) for b in books]
        for piece in blocks.pieces(batches, 1):
            for n, tree in enumerate(pickle.loads(piece.column(0)[0].as_py())["trees"]):
                if tree is not None:
                    _, c, t, _ = walk(tree, books[n])
                    count[n] += c
                    total[n] += t
        used = [(n, e) for n in range(len(books)) for e in np.flatnonzero(count[n]).tolist()]
        columns = [[n for n, _ in used], [e for _, e in used], [int(count[n][e]) for n, e in used], [total[n][e].tolist() for n, e in used]]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "entry", "n", "s"])

    return run


def _coder(books: list[np.ndarray], id_type: pa.DataType, label_type: pa.DataType, names: list[str]):
    most = max(map(len, books))
    digits = 2 if most <= 1 << 8 else 4 if most <= 1 << 16 else 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in blocks.pieces(batches, 1):
            block = pickle.loads(piece.column(0)[0].as_py())
            rows = len(block["ids"])
            code, error = np.zeros((rows, len(books)), dtype=f">u{digits // 2}"), np.zeros(rows, dtype=np.int64)
            for n, tree in enumerate(block["trees"]):
                if tree is not None:
                    label = walk(tree, books[n])[0]
                    away = tree["points"].astype(np.int64) - books[n][label]
                    code[:, n], error = label[tree["where"]], error + (away * away).sum(axis=1)[tree["where"]]
            text, width = code.tobytes().hex(), digits * len(books)
            codes = [text[i * width : (i + 1) * width] for i in range(rows)]
            yield pa.RecordBatch.from_arrays([pa.array(block["ids"], id_type), pa.array(block["labels"], label_type), pa.array(codes), pa.array(error)], names=names)

    return run


def code_vectors(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> Codes:
    """Codebooks learnt over all vectors, and every vector's code and squared error."""
    spark = vectors.sparkSession
    kept = vectors.where(blocks.all_finite(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    lead = blocks.first_vectors(kept, [F.col("id").asc_nulls_last()], 1)
    fields = [T.StructField(id_col, vectors.schema[id_col].dataType), T.StructField("label", vectors.schema[label_col].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    schema = T.StructType(fields)
    if not lead:
        return Codes(spark.createDataFrame([], schema), [])
    dims = len(lead[0])
    kept = kept.where(F.size("vector") == dims)
    first = blocks.whole(np.array(blocks.first_vectors(kept, [F.col("id").asc_nulls_last()], entries), dtype=np.float64).reshape(-1, dims), scale)
    books = [first[:, part] for part in _cuts(dims, parts)]
    path = scratch(spark, "cover-trees")
    kept.mapInArrow(_builder(scale, dims, parts), "payload binary").write.parquet(path)
    trees = spark.read.schema("payload binary").parquet(path)
    widest = max(b.shape[1] for b in books)
    for _ in range(rounds):
        found = trees.mapInArrow(_summer(books), "part int, entry int, n long, s array<long>")
        sums = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(widest)))
        books = [b.copy() for b in books]
        for r in sums.collect():  # parts * entries rows at most
            book = books[r["part"]]
            book[r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(book.shape[1])]
    from pyspark.sql.pandas.types import to_arrow_type

    rows = trees.mapInArrow(_coder(books, to_arrow_type(fields[0].dataType), to_arrow_type(fields[1].dataType), schema.fieldNames()), schema)
    return Codes(rows, [b.tolist() for b in books])


def with_label_errors(found: Codes) -> DataFrame:
    """Each row with the error of all rows of its label (nulls together) and the
    codebooks' digest.  Errors are added up per label before they meet the rows."""
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    rows = cut(found.rows.withColumn("_label_key", key))
    most = F.lit(blocks.LONG[1]).cast("decimal(38,0)")
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")).cast("decimal(38,0)"), most).cast("long")
    sums = cut(rows.groupBy("_label_key").agg(total.alias("label_error")))
    numbers = ",".join(str(v) for book in found.books for entry in book for v in entry)
    return join_bounded(rows, sums, "_label_key").drop("_label_key").withColumn("codebooks_sha256", F.lit(hashlib.sha256(numbers.encode()).hexdigest()))
