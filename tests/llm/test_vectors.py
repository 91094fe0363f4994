"""Vector searches against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rangeledger.llm import ann, topk
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<float>, label int, dim int, shard int, block int, id long, floor long, vector long, score long, query_id long"


def rows(n=700, dims=12, seed=3):
    rnd = random.Random(seed)
    common = [rnd.gauss(0, 0.3) for _ in range(dims)]
    out = {i: common if rnd.random() < 0.3 else [rnd.gauss(0, 0.3) for _ in range(dims)] for i in range(n)}
    return out


def frame(spark, vectors, extra=()):
    return spark.createDataFrame([(i, v, 0, 1, 1, 1, 1, 9, 9, 9, 9) for i, v in [*vectors.items(), *extra]], SCHEMA).repartition(3)


BAD = [(7000, None), (7100, [1.0, None, 2.0]), (7200, [float("nan")] * 12), (7300, [float("inf")] + [0.0] * 11), (None, [1.0] * 12)]


def floats(vectors):
    import numpy as np

    return {i: [float(np.float32(x)) for x in v] for i, v in vectors.items()}


@pytest.mark.parametrize(("shard_rows", "block_rows"), [(4096, 1024), (50, 3)])
def test_exact_top_k(spark, shard_rows, block_rows):
    vectors = rows()
    got = topk.exact_top_k(frame(spark, vectors, BAD), F.col("vec_id") % 20 == 0, 10, shard_rows=shard_rows, block_rows=block_rows)
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in floats(vectors).items()}
    want = brute.top(whole, range(0, len(vectors), 20), 10, lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)))
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("tile_rows", [4096, 60])
def test_nearest_by_cosine(spark, tile_rows):
    vectors = rows(seed=4)
    zero = [(8000, [0.0] * 12)]
    got = ann.nearest_by_cosine(frame(spark, vectors, BAD + zero), F.col("vec_id") % 20 == 0, 5, tile_rows=tile_rows, block_rows=7).collect()

    def cosine(a, b):
        dot = na = nb = 0.0
        for x, y in zip(a, b, strict=True):
            dot, na, nb = dot + x * y, na + x * x, nb + y * y
        return dot / (math.sqrt(na) * math.sqrt(nb))

    want = brute.top(floats(vectors), range(0, len(vectors), 20), 5, cosine)
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == sorted(w[:3] for w in want)
    assert {(r["query_id"], r["rank"]): r["score"] for r in got} == {w[:2]: w[3] for w in want}


def test_few_and_none(spark):
    two = {0: [1.0, 2.0], 100: [3.0, -1.0], 200: [1.0, 1.0, 1.0]}
    assert {tuple(r)[:3] for r in topk.exact_top_k(frame(spark, two), F.col("vec_id") % 100 == 0).collect()} == {(0, 1, 100), (100, 1, 0)}
    assert ann.nearest_by_cosine(frame(spark, two), F.col("vec_id") % 100 == 0).count() == 2
    none = spark.createDataFrame([], SCHEMA)
    assert topk.exact_top_k(none, F.col("vec_id") % 100 == 0).count() == 0
    assert ann.nearest_by_cosine(none, F.col("vec_id") % 50 == 0).count() == 0


def test_repeated_rows_and_large_components(spark):
    vectors = {0: [1e6, -2e6, 3e6], 1: [2e6, 2e6, 2e6], 2: [1.0, 1.0, 1.0]}
    got = topk.exact_top_k(frame(spark, vectors, [(1, [2e6, 2e6, 2e6]), (0, [1e6, -2e6, 3e6])]), F.col("vec_id") == 0, scale=1024.0).collect()
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in vectors.items()}
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, sum(a * b for a, b in zip(whole[0], whole[1], strict=True))), (2, sum(a * b for a, b in zip(whole[0], whole[2], strict=True)))]


def test_tiny_vectors_have_a_direction(spark):
    vectors = {0: [1e-30, 0.0], 1: [1.0, 0.0], 2: [0.0, 1.0]}
    got = ann.nearest_by_cosine(frame(spark, vectors), F.col("vec_id") == 0).collect()
    assert [(r["vec_id"], round(r["score"], 9)) for r in got] == [(1, 1.0), (2, 0.0)]
