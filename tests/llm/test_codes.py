"""Centroid clustering and product codes against plain versions."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeledger.llm import blocks, centroids, codes

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, distance long, code long, payload int, sums int, id int, vector int, first int"
BAD = [(7000, None, 1), (7001, [1.0, None] + [0.0] * 14, 1), (7002, [float("nan")] * 16, 2), (7003, [float("-inf")] + [0.0] * 15, None)]


def rows(n=900, dims=16, seed=1):
    """A hot vector, labels of which one is hot and some are null, repeated ids and rows, an id that is null."""
    rnd = random.Random(seed)
    hot = [rnd.gauss(0, 0.4) for _ in range(dims)]
    out = [(i, hot if rnd.random() < 0.3 else [rnd.gauss(i % 5, 0.4) for _ in range(dims)], None if rnd.random() < 0.1 else 0 if rnd.random() < 0.5 else i % 7) for i in range(n)]
    return [*out, out[5], (5, [0.25] * dims, 3), (None, [0.5] * dims, 3)]


def frame(spark, data):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, 7, 8) for r in data], SCHEMA).repartition(4)


def whole(v, scale):
    return [math.floor(scale * float(np.float32(x))) for x in v]


def nearest(v, book):
    return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(book))


def lloyd(points, book, rounds):
    for _ in range(rounds):
        groups = [[] for _ in book]
        for p in points:
            groups[nearest(p, book)[1]].append(p)
        book = [[sum(c) // len(g) for c in zip(*g, strict=True)] if g else b for g, b in zip(groups, book, strict=True)]
    return book, [nearest(p, book) for p in points]


def plain_clusters(data, dims, k, rounds):
    kept = [(i, whole(v, 1024)) for i, v, _ in data if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest())
    first = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    book, found = lloyd([v for _, v in kept], first, rounds)
    each = [sum(d for d, c in found if c == n) for n in range(len(book))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in book]
    return sorted((str(i), c, d, each[c], sum(each), sha[c]) for (i, _), (d, c) in zip(kept, found, strict=True))


def by_hash():
    return F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)


@pytest.mark.parametrize(("k", "rounds", "each"), [(8, 10, 2048), (5, 3, 7), (1, 1, 64)])
def test_clusters(spark, monkeypatch, k, rounds, each):
    monkeypatch.setattr(blocks.pieces, "__defaults__", (each,))
    data = [*rows(), *BAD, (8000, [1.0] * 15, 1)]
    got = centroids.with_cluster_facts(centroids.cluster_vectors(frame(spark, data), by_hash(), k, rounds, 16)).collect()
    assert got[0].__fields__ == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in got) == plain_clusters(data, 16, k, rounds)


def test_few_clusters_and_none(spark):
    two = [(1, [1.0] * 4, 0), (2, [-1.0] * 4, 0)]
    got = centroids.with_cluster_facts(centroids.cluster_vectors(frame(spark, two), by_hash(), 8, 10, 4)).collect()
    assert sorted(tuple(r) for r in got) == [(int(a), *b) for a, *b in plain_clusters(two, 4, 8, 10)]
    none = centroids.with_cluster_facts(centroids.cluster_vectors(frame(spark, BAD), by_hash(), 8, 10, 4))
    assert none.count() == 0 and none.columns[-1] == "centroid_sha256"


def test_huge_components_are_held(spark):
    data = [(1, [3e38, -3e38], 0), (2, [0.0, 0.0], 0), (3, [1.0, 1.0], 0)]
    got = {r["vec_id"]: r for r in centroids.cluster_vectors(frame(spark, data), by_hash(), 1, 1, 2).rows.collect()}
    assert len(got) == 3 and all(r["distance"] >= 0 for r in got.values())


def test_only_changed_components_are_multiplied():
    rng = np.random.default_rng(2)
    x, before = rng.integers(-900, 900, (50, 6)), rng.integers(-900, 900, (3, 6))
    after = before.copy()
    after[1, 4] += 7
    block = {"x": x.astype(np.int16), "dots": x @ before.T}
    centroids.moved(block, before, after)
    assert (block["dots"] == x @ after.T).all()


def plain_codes(data, parts, entries, rounds):
    kept = [(i, whole(v, 256), label) for i, v, label in data if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books, found = [], []
    for part in np.array_split(np.arange(len(kept[0][1])), parts):
        cut = lambda v, p=part: [v[i] for i in p]
        book, near = lloyd([cut(v) for _, v, _ in kept], [cut(v) for _, v, _ in first], rounds)
        books.append(book)
        found.append(near)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    code = ["".join(f"{f[n][1]:02x}" for f in found) for n in range(len(kept))]
    error = [sum(f[n][0] for f in found) for n in range(len(kept))]
    total = {}
    for (_, _, label), e in zip(kept, error, strict=True):
        total[label] = total.get(label, 0) + e
    return sorted((str(i), c, e, total[label], sha) for (i, _, label), c, e in zip(kept, code, error, strict=True))


@pytest.mark.parametrize(("parts", "entries", "rounds", "each"), [(4, 16, 2, 2048), (16, 64, 2, 50), (3, 5, 4, 2048), (20, 1, 1, 300)])
def test_codes(spark, monkeypatch, parts, entries, rounds, each):
    monkeypatch.setattr(blocks.pieces, "__defaults__", (each,))
    data = [*rows(500), *BAD]
    got = codes.with_label_errors(codes.code_vectors(frame(spark, data), parts, entries, rounds)).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == plain_codes(data, parts, entries, rounds)


def test_no_codes(spark):
    assert codes.with_label_errors(codes.code_vectors(frame(spark, BAD))).count() == 0


def test_whole_subtrees_are_settled():
    """Clusters far apart: nearly no point is compared by itself."""
    rng = np.random.default_rng(4)
    book = rng.integers(-30_000, 30_000, (8, 4))
    points = np.unique(np.concatenate([c + rng.integers(-40, 40, (400, 4)) for c in book]), axis=0)
    tree = codes.cover_tree(points, np.ones(len(points), dtype=np.int64))
    label, count, total, compared = codes.walk(tree, book)
    want = codes.squares(tree["points"], book).argmin(axis=1)
    assert (label == want).all() and compared < len(points) / 20
    assert (count == np.bincount(want, minlength=8)).all() and (total[3] == tree["points"][want == 3].sum(axis=0)).all()


def test_trees_cover_their_points():
    rng = np.random.default_rng(5)
    points = np.unique(rng.normal(0, 300, (1500, 4)).astype(np.int64), axis=0)
    tree = codes.cover_tree(points, np.ones(len(points), dtype=np.int64))
    for (start, end, first, last), centre, radius in zip(tree["nodes"], tree["centres"], tree["radii"], strict=True):
        away = np.sqrt(((tree["points"][start:end] - centre) ** 2).sum(axis=1))
        assert away.max() <= radius + 1e-9
        if last:
            assert (tree["radii"][first:last] <= radius / 2 + 1e-9).all() and tree["nodes"][first, 0] == start and tree["nodes"][last - 1, 1] == end
