"""The pipeline, each stage against a plain version on what the one before kept."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.llm.conftest import COPY, SCHEMA
from tests.llm.test_near_copies import all_pairs
from tests.llm.test_text_operators import key, tiktoken_encoding


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(11)
    good, bad = ["the", "house", "of", "green", "river", "and", "light", "stands", "over", "hill"], ["$$$", "buy!!", "###", "WIN", "||", "click%%"]
    rows, labels = [], []
    for i in range(240):
        fine = rnd.random() < 0.75
        text = " ".join(rnd.choice(good if fine else bad) + (str(rnd.randint(0, 99)) if rnd.random() < 0.4 else "") for _ in range(rnd.randint(30, 90)))
        if fine and rnd.random() < 0.3:
            text += " " + COPY
        rows.append((i, text, "en", f"s{i % 5}", len(text)))
        labels.append((i, int(fine), 0))
    rows += [(240 + i, rows[i][1], "en", "s0", rows[i][4]) for i in range(12)] + [(300, None, None, None, None), (301, "", "en", "s1", 0), (None, "of the house", "en", "s2", 12), (5, rows[5][1], "en", "s0", 1)]
    near = [(400 + n, i) for n, i in enumerate(i for i in range(240) if labels[i][1])][:60]
    for n, i in near:  # near copies: some words of a good text changed, added or left out
        words = rows[i][1].split()
        for _ in range(rnd.randint(1, 3)):
            words[rnd.randrange(len(words))] = "changed"
        rows.append((n, " ".join(words[: len(words) - rnd.randint(0, 2)]), "en", "s3", 1))
    rows.append((500, " ".join(rnd.choice(good) + str(rnd.randint(0, 9_999)) for _ in range(60_000)), "en", "s4", 1))
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("fp", "size", "place", "row_key", "root", "set_id", "keys", "copies")}).repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path), rows, dict((d, q) for d, q, _ in labels)


def test_stages(spark, folder, tmp_path):
    path, rows, labels = folder
    kept = {}
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, path)
        if n < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = [r.asDict() for r in docs.collect()]
    ids = lambda name: [r["doc_id"] for r in kept[name]]
    good = {d for d, q in labels.items() if q}
    assert good <= set(ids("quality")) and len(set(ids("quality")) & (set(labels) - good)) <= 3
    source = kept["quality"]
    # Exact Jaccard of five-word shingles over all pairs; a row without an id comes last.
    last = 10**9
    want = all_pairs([(last if r["doc_id"] is None else r["doc_id"], r["text"]) for r in source])
    assert sorted(last if x is None else x for x in ids("near_dedup")) == want and sum(400 <= x < 500 for x in want) < 50 and 500 in want
    want = {w[0]: w for w in brute.dedup([(r["doc_id"], r["text"]) for r in kept["near_dedup"]], 20)}
    before = {r["doc_id"]: r for r in kept["near_dedup"]}
    for r in kept["substring_dedup"]:
        _, total, removed, _ = want[r["doc_id"]]
        assert len(brute.words(r["text"])) == total - removed and (removed or r == before[r["doc_id"]])
    assert set(ids("near_dedup")) - set(ids("substring_dedup")) == {d for d, w in want.items() if w[2] and w[2] == w[1]}
    size = {}
    for r in kept["substring_dedup"]:
        size.setdefault(r["source"], []).append((r["doc_id"], len(brute.words(r["text"]))))
    totals, target = brute.targets([(s, n) for s, items in size.items() for _, n in items], (5, 2, 1), 1.5, 2.0)
    for s, items in size.items():
        taken = sum(len(brute.words(r["text"])) for r in kept["source_mix"] if r["source"] == s)
        assert abs(taken - target[s]) <= max((n for _, n in items), default=0) and taken <= 2 * totals[s]
    encoding = tiktoken_encoding()
    assert key((r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in kept["byte_bpe"]) == key((r["doc_id"], len(encoding.encode_ordinary(r["text"] or "")), brute.u4(encoding.encode_ordinary(r["text"] or ""))) for r in kept["source_mix"])


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
