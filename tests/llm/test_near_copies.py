"""Near copies of the pipeline's stage against all pairs' exact Jaccard."""

import random

import numpy as np

import corpus_pipeline
from rangeledger.llm import simhash
from tests.llm import brute
from tests.llm.conftest import SCHEMA, tricky_rows


def shingles(text, k=5):
    w = brute.words((text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def all_pairs(rows):
    """Ids that are the least of their component at a similarity of 0.8."""
    sets, root = [shingles(t) for _, t, *_ in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or len(a & b) / len(a | b) >= 0.8:
                root = [root[j] if r == root[i] else r for r in root]
    return sorted({min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in root})


def near_rows():
    rnd, rows = random.Random(5), []
    fresh = lambda n: [f"w{rnd.randint(0, 5000)}" for _ in range(n)]
    line = fresh(12)
    for _ in range(60):
        words = fresh(rnd.randint(40, 400))
        for edits in range(rnd.randint(1, 6)):
            copy = list(words)
            for _ in range(edits * rnd.randint(0, 3)):
                copy[rnd.randrange(len(copy))] = "changed"
            if rnd.random() < 0.2:
                words = copy  # chains: the next are copies of the copy
            text = " ".join(copy + (line if rnd.random() < 0.3 else []))
            rows.append((len(rows), text, "en", "s", len(text)))
    rows += [(9000, None, "en", "s", 0), (9001, "", "en", "s", 0), (9002, "one two", "en", "s", 7), (9003, "One TWO", "en", "s", 7)]
    return rows


def test_stage_removes_near_copies(spark):
    rows = near_rows()
    kept = corpus_pipeline.keep_one_of_near_copies(spark, spark.createDataFrame(rows, SCHEMA).repartition(5), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == all_pairs(rows)


def test_stage_decides_on_rows(spark):
    """Shared and null ids: different texts stay, of copies one least row."""
    word = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [
        (1, word("a"), "en", "s", 1), (1, word("b"), "en", "s", 1), (2, word("b"), "en", "s", 1), (None, word("b"), "en", "s", 1),
        (None, word("c"), "en", "s", 1), (None, word("c"), "en", "r", 1), (3, word("a"), "en", "s", 1), (3, word("d"), "en", "s", 1), (4, word("d"), "en", "s", 1),
    ]
    kept = corpus_pipeline.keep_one_of_near_copies(spark, spark.createDataFrame(rows, SCHEMA).repartition(4), "")
    want = [(1, "a0", "s"), (1, "b0", "s"), (3, "d0", "s"), (None, "c0", "r")]
    assert sorted(((r["doc_id"], r["text"].split()[0], r["source"]) for r in kept.collect()), key=str) == sorted(want, key=str)


def components_of(found):
    least = {}
    for r in found:
        least[r["root"]] = min(least.get(r["root"], r["doc_id"]), r["doc_id"])
    return sorted(least.values())


def test_large_groups_by_stars_and_tiles(spark):
    """Every group counts as large; no link is lost whatever the tiles."""
    rows = near_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for tile_rows in (2, 64):
        found = simhash.similar_texts(docs, group_rows=1, tile_rows=tile_rows).collect()
        assert len(found) == len(rows) and components_of(found) == all_pairs(rows)


def test_tricky_rows(tricky, empty):
    rows = [r for r in tricky_rows() if r[0] is not None]
    found = simhash.similar_texts(tricky.where("doc_id is not null")).collect()
    assert len(found) == len(rows) and components_of(found) == all_pairs(rows)
    assert len(simhash.similar_texts(tricky).collect()) == len(tricky_rows()) and simhash.similar_texts(empty).count() == 0


def test_trie_pairs_of_two_labels():
    """Equal fingerprints and labels, against all pairs."""
    rnd = np.random.default_rng(3)
    for labels in (1, 2, 30):
        group, fp = np.sort(rnd.integers(0, 4, 200)), rnd.integers(0, 40, 200, dtype=np.uint64)
        fp = fp[np.lexsort((fp, group))]
        label = rnd.integers(0, labels, 200)
        a, b = simhash.trie_pairs(group, fp, 2, label)
        want = {(i, j) for j in range(200) for i in range(j) if group[i] == group[j] and label[i] != label[j] and int(fp[i] ^ fp[j]).bit_count() <= 2}
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == want and len(a) == len(want)


def test_set_fingerprint_is_the_majority():
    for text in ("", "one two", "a b c d e f g h", " ".join(map(str, range(500)))):
        h = simhash.shingle_hashes(text, 3)
        want = sum(1 << k for k in range(64) if len(h) and 2 * sum(int(x) >> k & 1 for x in h) > len(h))
        assert simhash.set_fingerprint(h) == want


def test_common_shingles():
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 50, n, dtype=np.int64)) for n in (0, 1, 30, 50, 200)]
    got = simhash.common_shingles(sets, sets[1:])
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[1:]] for a in sets]


def test_a_family_below_the_threshold(spark):
    """Many texts that share keys and are mostly not similar: no link is lost or made up."""
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rnd.choice([2, 4, 6, 8])):
            words[rnd.randrange(120)] = f"x{rnd.randint(0, 10**6)}"
        rows.append((i, " ".join(words), "en", "s", 0))
    found = simhash.similar_texts(spark.createDataFrame(rows, SCHEMA).repartition(4), tile_rows=40).collect()
    assert components_of(found) == all_pairs(rows) and 1 < len(components_of(found)) < 150
