"""Nearest neighbours by cosine: a block matrix join of int8 tiles.

Unit vectors are quantised to int8 with a scale and the norm of their rounding
error per vector.  For a tile of candidates and a block of queries the int8
product gives every cosine to within a bound made of those error norms; a pair
survives if its upper bound reaches the query's k-th best lower bound.  Only
surviving pairs are computed again in double precision from the original
vectors, and heaps keep the best k of each cell, merged over all cells.  As the
bounds are proven, nothing among the nearest is lost: recall is 1.

Defined cases: rows with a null id, or a vector that is null, zero or has a null
or non-finite component, take no part; rows sharing an id are one item (its
least vector); vectors of different length are not compared; ties go to the
smaller id; fewer than k candidates give all; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame

from rangeledger.llm.vectors import best, cells, dealt, fewest_copies, finite_vectors, in_blocks, one_per_id, one_query_per_id, parts

#: Rounding of the double-precision arithmetic on bounds.
SLACK = 1e-9
FOUND = "query_id long, vec_id long, score double"


def summed(products: np.ndarray) -> np.ndarray:
    """Row sums, component after component: copies score alike wherever they are."""
    return np.cumsum(products, axis=1)[:, -1] if products.shape[1] else np.zeros(len(products))


def quantised(ids: np.ndarray, rows: np.ndarray) -> dict:
    norms = np.sqrt(summed(rows * rows))
    odd = ~np.isfinite(norms) | (norms == 0)
    if odd.any():  # zero, or squares out of range
        top = np.abs(rows[odd]).max(axis=1, initial=0.0)
        rows[odd] /= np.where(top > 0, top, 1.0)[:, None]
        norms[odd] = np.sqrt(summed(rows[odd] * rows[odd]))
        ids, rows, norms = ids[norms > 0], rows[norms > 0], norms[norms > 0]
    unit = rows / norms[:, None]
    scale = np.abs(unit).max(axis=1, initial=0.0) / 127
    q8 = np.rint(unit / scale[:, None]).astype(np.int8)
    near = q8 * scale[:, None]
    return {"ids": ids, "rows": rows, "norms": norms, "q8": q8, "scale": scale, "size": np.sqrt((near**2).sum(axis=1)), "error": np.sqrt(((unit - near) ** 2).sum(axis=1))}


def pack_tile(k: int, key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    ids, rows = one_per_id(pdf)
    kept = fewest_copies(ids, rows, k + 1)
    return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "tile": [pickle.dumps(quantised(ids[kept], rows[kept]), protocol=5)]})


def join_tile(c: dict, q: dict, k: int) -> list[tuple[int, int, float]]:
    """The k nearest of tile ``c`` for every query of ``q``."""
    wide = np.float32 if c["q8"].shape[1] * 127 * 127 < 2**24 else np.float64  # integers stay exact
    right, out = c["q8"].astype(wide).T, []
    for part in in_blocks(len(q["ids"]), 256):
        product = (q["q8"][part].astype(wide) @ right).astype(np.float64) * (q["scale"][part, None] * c["scale"][None, :])
        error = q["size"][part, None] * c["error"][None, :] + q["error"][part, None] * (c["size"] + c["error"])[None, :] + SLACK
        own = q["ids"][part, None] == c["ids"][None, :]
        lower = np.where(own, -np.inf, product - error)
        if lower.shape[1] > k:
            floor = np.partition(lower, lower.shape[1] - k, axis=1)[:, lower.shape[1] - k]
        else:
            floor = np.full(lower.shape[0], -np.inf)
        i, j = np.nonzero((product + error >= floor[:, None]) & ~own)
        score = np.empty(len(i))
        for some in in_blocks(len(i), 16384):
            a, b = i[some] + part.start, j[some]
            score[some] = summed(q["rows"][a] * c["rows"][b]) / (q["norms"][a] * c["norms"][b])
        ends = np.searchsorted(i, np.arange(lower.shape[0] + 1))
        for n in range(lower.shape[0]):
            pairs = zip(score[ends[n] : ends[n + 1]].tolist(), (-c["ids"][j[ends[n] : ends[n + 1]]]).tolist(), strict=True)
            out += [(int(q["ids"][part.start + n]), -neg, s) for s, neg in heapq.nlargest(k, pairs)]
    return out


def _packer(k: int):
    return lambda key, pdf: pack_tile(k, key, pdf)


def _joiner(k: int):
    def cell(packed: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = join_tile(pickle.loads(packed["tile"].iloc[0]), quantised(*one_per_id(queries)), k) if len(packed) and len(queries) else []
        found = pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
        return found.astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return cell


def nearest_by_cosine(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", tile_rows: int = 4096, block_rows: int = 2048
) -> DataFrame:
    """Per query row: query_id, rank, vec_id, score of its k largest cosines."""
    base = finite_vectors(vectors, id_col, vector_col)
    asked = one_query_per_id(finite_vectors(vectors.where(is_query), id_col, vector_col))
    shards = parts(vectors.count(), tile_rows)
    dealt_out = base.withColumn("shard", dealt(shards, 3)).repartition(min(shards, 20_000), "dim", "shard")
    tiles = dealt_out.groupBy("dim", "shard").applyInPandas(_packer(k), "dim int, shard int, tile binary")
    return best(cells(tiles, asked, shards, block_rows, _joiner(k), FOUND), k)
