"""Exact top-k inner products: ball trees per shard, branch and bound.

Vectors are dealt into shards; each shard's ball tree is built once and kept in
the shared folder as one row.  The search runs twice over the cells of shards
and query blocks.  First every shard opens only its most promising leaf; the
k-th best score over all shards is a proven floor of the query's result.  Then
every shard searches best first, by the upper bound ``q.c + |q| r`` of a node's
inner products, starting from that shared floor and giving up a node once its
bound is below it or below the k-th score found in the shard.

Components become ``floor(scale * x)``; scores are exact integers (beyond 2**53
by Python integers, held to the range of long).

Defined cases: rows with a null id, or a vector that is null or has a null or
non-finite component, take no part; rows sharing an id are one item (its least
vector); vectors of different length are not compared; ties go to the smaller
id; fewer than k candidates give all; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeledger.llm.common import cut
from rangeledger.llm.vectors import best, cells, dealt, fewest_copies, finite_vectors, one_per_id, one_query_per_id, parts

LEAF_ROWS = 64


def scaled(rows: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(rows * scale)


def exact_products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of integer-valued float64 rows with q."""
    top = float(np.abs(rows).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, rows.shape[1])
    if top < 2.0**53:
        return (rows @ q).astype(np.int64)
    low, high = -(2**63), 2**63 - 1
    return np.array([min(high, max(low, sum(int(a) * int(b) for a, b in zip(r, q, strict=True)))) for r in rows], dtype=np.int64)


def build_tree(ids: np.ndarray, rows: np.ndarray) -> dict:
    """Balanced ball tree over the rows; nodes list their range of ``order``."""
    order = np.arange(len(ids))
    nodes: list[list[int]] = []  # start, end, left, right
    centres, radii = [], []
    todo = [(0, len(ids), -1, 0)]
    while todo:
        start, end, parent, side = todo.pop()
        own = rows[order[start:end]]
        centre = own.mean(axis=0)
        away = np.sqrt(((own - centre) ** 2).sum(axis=1))
        at = len(nodes)
        nodes.append([start, end, -1, -1])
        centres.append(centre)
        radii.append(float(away.max(initial=0.0)))
        if parent >= 0:
            nodes[parent][2 + side] = at
        if end - start > LEAF_ROWS and radii[-1] > 0:
            one = own[away.argmax()]
            other = own[((own - one) ** 2).sum(axis=1).argmax()]
            half = (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(own @ (other - one), half)]
            todo += [(start, start + half, at, 0), (start + half, end, at, 1)]
    small = np.abs(rows).max(initial=0) < 2**15
    return {
        "ids": ids[order], "rows": rows[order].astype(np.int16) if small else rows[order],
        "nodes": np.array(nodes, dtype=np.int32), "centres": np.array(centres), "radii": np.array(radii),
    }


def pack_shard(scale: float, k: int, key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    ids, rows = one_per_id(pdf)
    rows = scaled(rows, scale)
    kept = fewest_copies(ids, rows, k + 1)
    tree = pickle.dumps(build_tree(ids[kept], rows[kept]), protocol=5)
    return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "tree": [tree]})


def _search(tree: dict, bounds: np.ndarray, q_id: int, q: np.ndarray, k: int, floor: float, one_leaf: bool) -> list[tuple[int, int]]:
    ids, rows, nodes = tree["ids"], tree["rows"], tree["nodes"]
    heap, found = [(-bounds[0], 0)], []  # found: least of (score, -id) first
    while heap:
        bound, at = heapq.heappop(heap)
        if -bound < (max(floor, found[0][0]) if len(found) == k else floor):
            break
        start, end, left, right = nodes[at]
        if left >= 0:
            for child in (left, right):
                heapq.heappush(heap, (-bounds[child], int(child)))
            continue
        score = exact_products(rows[start:end], q)
        least = max(floor, found[0][0]) if len(found) == k else floor
        near = np.flatnonzero((score >= least) & (ids[start:end] != q_id))
        if len(near) > k:
            near = near[np.lexsort((ids[start:end][near], -score[near]))[:k]]
        for i in near:
            item = (int(score[i]), -int(ids[start + i]))
            if len(found) < k:
                heapq.heappush(found, item)
            elif item > found[0]:
                heapq.heapreplace(found, item)
        if one_leaf and found:
            break
    return found


def search_cell(scale: float, k: int, one_leaf: bool, packed: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    out: list[tuple[int, int, int]] = []
    if len(packed) and len(queries):
        tree = pickle.loads(packed["tree"].iloc[0])
        tree["rows"] = tree["rows"].astype(np.float64)
        floors = dict(zip(queries["id"], queries["floor"], strict=True))
        ids, rows = one_per_id(queries)
        rows = scaled(rows, scale)
        norms = np.sqrt((rows**2).sum(axis=1))
        reach = norms[:, None] * tree["radii"][None, :]
        slack = 1e-9 * (norms[:, None] * np.sqrt((tree["centres"] ** 2).sum(axis=1))[None, :] + reach) + 1e-6
        bounds = rows @ tree["centres"].T + reach + slack
        for i, q_id in enumerate(ids):
            floor = floors[q_id]
            floor = -np.inf if floor is None or pd.isna(floor) else floor
            out += [(int(q_id), -neg, score) for score, neg in _search(tree, bounds[i], q_id, rows[i], k, floor, one_leaf)]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")


def _packer(scale: float, k: int):
    return lambda key, pdf: pack_shard(scale, k, key, pdf)


def _searcher(scale: float, k: int, one_leaf: bool):
    return lambda packed, queries: search_cell(scale, k, one_leaf, packed, queries)


FOUND = "query_id long, vec_id long, score long"


def exact_top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding",
    shard_rows: int = 4096, block_rows: int = 1024,
) -> DataFrame:
    """Per query row: query_id, rank, vec_id, score of its k largest inner products.

    ``is_query`` is a condition on the id column that marks the stated query set."""
    base = finite_vectors(vectors, id_col, vector_col)
    asked = one_query_per_id(finite_vectors(vectors.where(is_query), id_col, vector_col))
    shards = parts(vectors.count(), shard_rows)
    dealt_out = base.withColumn("shard", dealt(shards, 3)).repartition(min(shards, 20_000), "dim", "shard")
    trees = cut(dealt_out.groupBy("dim", "shard").applyInPandas(_packer(scale, k), "dim int, shard int, tree binary"))
    first = cells(trees, asked.withColumn("floor", F.lit(None).cast("double")), shards, block_rows, _searcher(scale, k, True), FOUND)
    # Scores above 2**53 lose digits as double: their floor is lowered to stay one.
    floors = best(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), (F.col("score").cast("double") - F.when(F.abs("score") > (1 << 53), F.abs("score") * 1e-12).otherwise(0.0)).alias("floor"))
    floors = cut(floors)
    second = asked.join(floors, "id", "left").select("id", "vector", "dim", "floor")
    return best(cells(trees, second, shards, block_rows, _searcher(scale, k, False), FOUND), k)
