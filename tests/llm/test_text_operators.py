"""Text operators against brute force, on tricky and on empty tables."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rangeledger.llm import attribution, bpe, cas, components, mixing, quality, sharding, simhash, substring
from rangeledger.llm.text import word_pieces
from tests.llm import brute
from tests.llm.conftest import COPY, SCHEMA, tricky_rows

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
key = lambda rows: sorted(map(str, rows))


def random_docs(spark, n=120, seed=5):
    rnd = random.Random(seed)
    passages = [" ".join(rnd.choice("abcdefghij") * rnd.randint(1, 4) for _ in range(30)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(rnd.choice("klmnopqrst") * rnd.randint(1, 3) for _ in range(rnd.randint(0, 60))) for _ in range(3)]
        if rnd.random() < 0.4:
            parts.insert(rnd.randint(0, 2), rnd.choice(passages))
        rows.append((i, " ".join(parts), "en", f"s{rnd.randint(0, 4) // 2}", 0))
    rows += [(n + i, rows[i][1], "en", "s9", 0) for i in range(10)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4), rows


# SimHash


def test_trie_pairs_equal_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    flips = [base ^ (np.uint64(1) << rng.integers(0, 64, 20).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 20).astype(np.uint64)) for _ in range(12)]
    fp = np.unique(np.concatenate(flips))
    group = np.sort(rng.integers(0, 4, len(fp)))
    order = np.lexsort((fp, group))
    group, fp = group[order], fp[order]
    for budget in (0, 1, 2, 3):
        got = list(zip(*(x.tolist() for x in simhash.trie_pairs(group, fp, budget)), strict=True))
        want = [(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if group[i] == group[j] and (int(fp[i]) ^ int(fp[j])).bit_count() <= budget]
        assert sorted(got) == want


def test_near_duplicates(tricky):
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(tricky, 3, 2).collect()}
    rows = tricky_rows()
    prints = [brute.fingerprint(r[1], 3) for r in rows]
    want = set(zip([r[0] for r in rows], [f"{p:016x}" for p in prints], brute.components([r[0] for r in rows], prints, 2), strict=True))
    assert got == want and simhash.near_duplicates(tricky, 3, 2).count() == len(rows)


def test_links_of_a_dense_group_are_not_lost(spark):
    """A group above every bound is dealt by segments, then by tiles."""
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(600)} | {rng.getrandbits(64) for _ in range(200)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long"), 2, group_rows=16)
    root = {r["node"]: r["root"] for r in components.components(links).collect()}
    got = [root.get(s, s) for s in signed]
    want = brute.components(signed, prints, 2)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_long_text_in_pieces():
    text = " ".join(f"w{i}" for i in range(5000))
    assert [w for p in word_pieces(text.encode(), 100) for w in p] == text.encode().split()
    assert simhash.fingerprint(text, 3) == brute.fingerprint(text, 3)


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(50)] + [(i, 100) for i in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {i: 100 for i in range(101, 160)}


# Substring dedup


def digest(df):
    return [tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]


def test_substring_dedup(spark):
    docs, rows = random_docs(spark)
    for width in (20, 5):
        assert key(digest(substring.substring_digest(docs, width))) == key(brute.dedup([r[:2] for r in rows], width))


def test_substring_dedup_with_few_cells(spark):
    """A crowded sketch lets more windows through and changes nothing."""
    docs, rows = random_docs(spark, 60)
    done = substring.dedup_substrings(docs.select("doc_id", "text"), 20, max_cells=256)
    assert sum(r["n_removed"] for r in done.collect()) == sum(r[2] for r in brute.dedup([r[:2] for r in rows], 20))


def test_substring_dedup_of_whole_copies(spark):
    """Later copies stay out of the sketch; their first place keeps its words."""
    docs, rows = random_docs(spark, 60)
    rows = [r[:2] for r in rows] + [(1000 + 60 * k + i, rows[i][1]) for k in range(3) for i in range(40)]
    again = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("n_words", "n_removed", "kept_text", "firsts", "copy", "c0", "k")})
    done = substring.dedup_substrings(again, 20)
    assert done.columns == ["doc_id", "text", "firsts", "copy", "c0", "k", "n_words", "n_removed", "kept_text"]
    assert {r["firsts"] for r in done.collect()} == {7}
    assert key(digest(substring.substring_digest(again, 20))) == key(brute.dedup(rows, 20))


def test_substring_tricky(tricky):
    done = substring.dedup_substrings(tricky, 20)
    assert done.columns[: len(tricky.columns)] == tricky.columns
    assert key(digest(substring.substring_digest(tricky, 20))) == key(brute.dedup([r[:2] for r in tricky_rows()], 20))


# Mixing


def test_targets_and_mix(spark):
    docs, rows = random_docs(spark, 400)
    out = mixing.mix_sources(docs).collect()
    totals, target = brute.targets([(r[3], len(brute.words(r[1]))) for r in rows], (5, 2, 1), 1.5, 2.0)
    source = {r[0]: r[3] for r in rows}
    taken = {}
    for r in out:
        s = source[r["doc_id"]]
        assert r["source_size"] == totals[s] and abs(r["target"] - target[s]) < 1e-6
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] in (0, 1, 2)
        taken[s] = taken.get(s, 0) + r["taken"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.02 * t + 1
    assert key(map(tuple, out)) == key(map(tuple, mixing.mix_sources(docs).collect()))


def test_mix_tricky(tricky):
    out = mixing.mix_sources(tricky).collect()
    assert len(out) == len(tricky_rows())
    totals, target = brute.targets([(r[3], len(brute.words(r[1]))) for r in tricky_rows()], (5, 2, 1), 1.5, 2.0)
    sizes = {(r["source_size"], round(r["target"], 6)) for r in out}
    assert sizes == {(totals[s], round(t, 6)) for s, t in target.items()}
    assert all(r["taken"] <= 2 * r["size"] for r in out)
    # A source's taken words miss its target by less than its largest document.
    source = {(r[0], len(brute.words(r[1]))): r[3] for r in tricky_rows() if r[0] is not None and r[0] != 7}
    for s in {r[3] for r in tricky_rows()} - {"c", "a", "b"}:
        taken = sum(r["taken"] for r in out if source.get((r["doc_id"], r["size"]), "-") == s)
        assert abs(taken - target[s]) <= max(len(brute.words(r[1])) for r in tricky_rows() if r[3] == s)


def test_gaps_are_closed_with_several_documents(spark):
    """A large document stands where the source is full: small ones fill what is left."""
    rows = [(i, "w " * (900 if i % 10 == 0 else 7 + i % 5), f"s{i % 2}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in range(3):
        out = mixing.mix_sources(docs, share=0.7, seed=seed, tilt=F.sqrt("size")).join(docs.select("doc_id", "source"), "doc_id")
        for r in out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
            assert abs(r["taken"] - r["target"]) <= 5


def test_tilt_prefers_heavier_documents(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("source"), F.when(F.col("id") % 4 < 2, 5.0).otherwise(0.2).alias("t"))
    out = mixing.mix_sources(docs, weights=(1, 1), share=0.5, tilt="t").join(docs.select("doc_id", "t"), "doc_id")
    got = {r["t"]: r["n"] for r in out.groupBy("t").agg(F.sum("copies").alias("n")).collect()}
    assert got[5.0] > 3 * got[0.2]


# Sharding


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40, 1000])
def test_permutation_and_its_inverse(spark, n):
    df = spark.range(n).select("id", sharding.permuted_row("id", n, 9).alias("p")).select("id", "p", sharding.original_row("p", n, 9).alias("back"))
    rows = df.collect()
    assert sorted(r["p"] for r in rows) == list(range(n)) and all(r["back"] == r["id"] for r in rows)


def test_shards(tricky):
    out = sharding.shard_documents(tricky, 4).collect()
    rows = tricky_rows()
    assert key((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == key((r[0], len((r[1] or "").encode()) + 16, brute.crc(r[1])) for r in rows)
    for s in range(4):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots))) and len(slots) in (len(rows) // 4, -(-len(rows) // 4))
    assert key(map(tuple, out)) == key(map(tuple, sharding.shard_documents(tricky.repartition(2), 4).collect()))


def test_written_shards(spark, tmp_path):
    docs, rows = random_docs(spark)
    sharding.write_shards(docs, str(tmp_path / "s"), 4)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(rows)


def test_written_shards_keep_rows_that_share_an_id(spark, tmp_path):
    rows = [(1, "one", "x", 5), (1, "other", "y", 5), (2, "two", "z", 5), (3, "three", "z", 5), (None, None, "n", 5), (None, "no id", "n", 5), (3, "three", "z", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size string, slot long")
    sharding.write_shards(docs, str(tmp_path / "s"), 2)
    got = spark.read.parquet(str(tmp_path / "s")).collect()
    assert key((r["doc_id"], r["text"], r["size"]) for r in got) == key(r[:3] for r in rows)
    assert sorted((r["shard"], r["slot"]) for r in got) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1), (1, 2)]


# Byte-level BPE


def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_round_trip(spark, tricky):
    encoding = tiktoken_encoding()
    docs, rows = random_docs(spark, 60)
    for df, texts in ((tricky, [r[:2] for r in tricky_rows()]), (docs, [r[:2] for r in rows])):
        got = bpe.bpe_round_trip(df, RANKS, public_tokenizers.PATTERN).collect()
        want = []
        for doc, text in texts:
            ids = encoding.encode_ordinary(text or "")
            want.append((doc, len(ids), hashlib.sha256(brute.u4(ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
        assert key(map(tuple, got)) == key(want)


def test_decoding_gives_the_text_back(tricky):
    encoded = bpe.encode_documents(tricky, RANKS, public_tokenizers.PATTERN)
    got = bpe.decode_documents(encoded, RANKS).collect()
    assert key((r["doc_id"], bytes(r["decoded"]).decode()) for r in got) == key((r[0], r[1] or "") for r in tricky_rows())


def test_folded_merges_equal_the_helper(spark):
    ranks = bpe.read_ranks(RANKS)
    words = [" the", "antidisestablishment", "a", " zzzq", "日本", "Straße", " 12345", "!!!!", "don't"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for r in df.select("word", bpe.fold_merges("word", ranks).alias("p")).collect():
        assert [ranks[bytes.fromhex(p)] for p in r["p"]] == bpe.merge_ranked(r["word"].encode(), ranks)


def test_encoder_equals_tiktoken():
    rnd, encoding = random.Random(1), tiktoken_encoding()
    encoder = bpe.Encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN, {})
    letters = [*"ab eE'st  \n\t.,19", "\x1c", "\x85", "\xa0", "ß", "日", "\U0001f600", "́", " ", "'ll", "don't", "<|endoftext|>"]
    for _ in range(4000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 14)))
        assert encoder.encode(text) == brute.u4(encoding.encode_ordinary(text)), repr(text)
    long = "".join(rnd.choice("abcdef") for _ in range(20_000))
    assert encoder.encode(long) == brute.u4(encoding.encode_ordinary(long))


# Content-addressed store


def test_store(spark, tricky, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    docs, rows = random_docs(spark)
    for name, df, source in (("t", tricky, tricky_rows()), ("r", docs, rows)):
        path = str(tmp_path / name)
        got = cas.store_and_read(df, WORDS, 1, path).orderBy("start").collect()
        streams = [[*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in source]
        by_id = sorted(((r[0] is None, r[0] or 0), s) for r, s in zip(source, streams, strict=True))
        assert [g["doc_id"] if g["doc_id"] is not None else None for g in got] == [None if k[0] else k[1] for k, _ in by_id]
        assert key((g["doc_id"], g["n_tokens"], g["ids_crc32"]) for g in got) == key((r[0], len(s), zlib.crc32(brute.u4(s))) for r, s in zip(source, streams, strict=True))
        at = 0
        for g in got:
            assert g["start"] == at
            at += g["n_tokens"]
        chunks = spark.read.parquet(f"{path}/objects").where("not is_recipe")
        assert chunks.count() == chunks.select("name").distinct().count()


def test_special_tokens_are_their_ids():
    """As the library's plain call has it, in any surrounding."""
    from tokenizers import Tokenizer

    tokenizer, words = Tokenizer.from_file(WORDS), cas.WordIds(WORDS)
    rnd, parts = random.Random(9), ["<|startoftext|>", "<|endoftext|>", "<|EndOfText|>", "<|", "|>", "a", "It's", " ", "\n", "12", "Ünïx", "...", "<", "<|endoftext"]
    texts = ["a <|endoftext|> b", "<|startoftext|>", ""] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 12))) for _ in range(2000)]
    for text in texts:
        assert np.frombuffer(words.stream(text), dtype=words.kind).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_another_tokenizer_file_is_asked_for_whole_texts(spark, tricky, tmp_path):
    from tokenizers import Tokenizer

    other = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(other)
    assert not cas.WordIds(other).by_word and cas.WordIds(WORDS).by_word
    got = cas.store_and_read(tricky, other, 1, str(tmp_path / "o")).collect()
    streams = [(r[0], [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in tricky_rows()]
    assert key((g["doc_id"], g["n_tokens"], g["ids_crc32"]) for g in got) == key((d, len(s), zlib.crc32(brute.u4(s))) for d, s in streams)


def test_segments_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cas, "SEGMENT_ROWS", 7)
    docs, rows = random_docs(spark)
    path = str(tmp_path / "b")
    assert cas.store_and_read(docs, WORDS, 1, path).count() == len(rows)
    assert spark.read.parquet(f"{path}/manifest").agg(F.max("documents"), F.sum("documents")).first() == (7, len(rows))


def test_damage_is_found(spark, tmp_path):
    docs, _ = random_docs(spark, 20)
    path = str(tmp_path / "d")
    cas.write_store(docs, path, WORDS, 1)
    broken = spark.read.parquet(f"{path}/objects").withColumn("data", F.when(F.col("data").isNotNull(), F.concat(F.col("data"), F.unhex(F.lit("0000")))))
    broken.write.parquet(f"{path}/broken")
    import shutil

    shutil.rmtree(f"{path}/objects")
    shutil.move(f"{path}/broken", f"{path}/objects")
    with pytest.raises(Exception, match="damaged"):
        cas.read_documents(spark, path).collect()


def test_chunks_do_not_depend_on_what_stands_before():
    rng = np.random.default_rng(4)
    tail = rng.integers(0, 40_000, 20_000).astype(np.uint16)
    a, b = cas.chunk_ends(tail), cas.chunk_ends(np.concatenate([rng.integers(0, 40_000, 777).astype(np.uint16), tail]))
    assert len({e - len(tail) for e in a} & {e - len(tail) - 777 for e in b}) > len(a) // 2
    assert np.diff([0, *a]).max() <= cas.MOST and a[-1] == len(tail)


def test_combined_checksums():
    rng = np.random.default_rng(6)
    data = rng.integers(0, 256, 10_000, dtype=np.uint8).tobytes()
    cuts = [0, 17, 4000, 4001, 9999, 10_000]
    parts = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    shares = cas.crc_before(np.array([zlib.crc32(p) for p in parts], dtype=np.int64), np.array([len(data) - b for b in cuts[1:]]))
    assert int(np.bitwise_xor.reduce(shares)) == zlib.crc32(data)


# Token counts


def plain_sections(text):
    """Sentences by a walk over characters: a mark and the white space behind it end one."""
    parts, now = [], ""
    for i, c in enumerate(text):
        now += c
        if c.isspace() and i and text[i - 1] in ".!?" and len(now) > 1:
            parts.append(now)
            now = ""
    return parts + [now] if now or not parts else parts


@pytest.mark.parametrize("rule", attribution.RULES)
def test_section_tokens(spark, tricky, rule):
    encoding = tiktoken_encoding()
    more = [(500, "End.\n\nNext! one? two ...  Three. ", "en", "a", 1), (501, ". . . .", "en", "a", 1), (502, "A.\n\n\n\nB", "en", "a", 1), (503, "Ü.é! 日本. ok", "en", "a", 1)]
    docs = tricky.select("doc_id", "text").unionByName(spark.createDataFrame(more, SCHEMA).select("doc_id", "text"))
    got = attribution.section_token_counts(docs, RANKS, public_tokenizers.PATTERN, rule).collect()
    want, crossed = [], 0
    for r in [*tricky_rows(), *more]:
        text = r[1] or ""
        parts = plain_sections(text)
        owner = [i for i, p in enumerate(parts) for _ in p.encode()]
        counts, crossing, at = [0] * len(parts), [0] * len(parts), 0
        for token in encoding.encode_ordinary(text):
            span = owner[at : at + len(encoding.decode_single_token_bytes(token))]
            at += len(span)
            at_section = {"start": span[0], "end": span[-1], "most": max(sorted(set(span)), key=span.count)}[rule]
            counts[at_section] += 1
            crossing[at_section] += span[0] != span[-1]
        crossed += sum(crossing)
        chars = 0
        for i, p in enumerate(parts):
            want.append((r[0], i, chars, chars + len(p), counts[i], crossing[i]))
            chars += len(p)
    assert crossed and key(map(tuple, got)) == key(want)


def test_attribution_over_whole_sections():
    counted, crossing = attribution.attribute(np.array([3, 4, 9]), np.array([1, 2, 6, 8, 16]), "most")
    assert counted.tolist() == [1, 0, 1, 0, 1] and crossing.tolist() == [1, 0, 1, 0, 1]


# Quality


def labelled(spark, n=300):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        good = rnd.random() < 0.7
        words = ["the", "house", "of", "green", "river", "and", "light", "stands", "over"] if good else ["$$$", "buy!!", "###", "WIN", "||", "click%%"]
        rows.append((i, " ".join(rnd.choice(words) for _ in range(rnd.randint(20, 80))), "en", "a", 0))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_held_out(spark):
    docs, labels = labelled(spark)
    out = quality.score_documents(docs, quality.fit_quality(docs, labels)).join(labels, "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.score_documents(docs, quality.fit_quality(docs, flipped)).collect()
    assert {r["doc_id"]: r["score"] for r in again} == {r["doc_id"]: r["score"] for r in out}


def test_quality_score_equals_a_plain_version(spark, tricky):
    """Sizes by the command-line format's own frames, block after block, and a logistic."""
    import math

    import zstandard

    docs, labels = labelled(spark)
    model = quality.fit_quality(docs, labels)
    sizes = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False, write_checksum=False) for d in (model.good, model.bad)]
    for r in tricky.withColumn("score", quality.quality_score(model)).collect():
        data = (r["text"] or "").encode()
        g, b = (sum(len(c.compress(data[i : i + 512])) for i in range(0, len(data), 512)) for c in sizes)
        x = (b - g) / (b + g) if b + g else 0.0
        assert abs(r["score"] - 1 / (1 + math.exp(-(model.slope * x + model.offset)))) < 1e-12


def test_quality_learns_from_whole_texts(spark):
    """Marks that stand only behind a long common opening are learned."""
    rnd = random.Random(5)
    opening = " ".join(rnd.choice("alpha beta gamma delta".split()) for _ in range(3000))
    docs, labels = labelled(spark)
    docs = docs.withColumn("text", F.concat(F.lit(opening + " "), F.repeat(F.concat("text", F.lit(" ")), 20)))
    out = quality.score_documents(docs, quality.fit_quality(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert sum((r["score"] >= 0.5) == (r["quality"] == 1) for r in out) >= 0.9 * len(out)


def test_drawn_blocks_come_from_all_over():
    text = "".join(f"{i:06d}" for i in range(10_000))
    at = [text.index(b.decode()) for b in quality.drawn_blocks(text, 8)]
    assert len(at) == 8 and at == sorted(at) and all(i % 512 == 0 for i in at) and at[-1] > 20_000


def test_quality_tricky(spark, tricky, empty):
    docs, labels = labelled(spark)
    model = quality.fit_quality(docs, labels.unionByName(labels.limit(5)).unionByName(spark.createDataFrame([(None, 1, 0), (3, None, 0)], labels.schema)))
    out = quality.score_documents(tricky, model).collect()
    assert len(out) == len(tricky_rows()) and all(0 <= r["score"] <= 1 for r in out)
    assert quality.score_documents(empty, model).count() == 0
    none = quality.fit_quality(empty, labels.limit(0))
    assert {r["score"] for r in quality.score_documents(tricky, none).collect()} == {0.5}
    only = quality.fit_quality(docs, labels.where("quality = 1"))
    assert {r["predicted"] for r in quality.score_documents(tricky, only).collect()} == {1}
    few = quality.fit_quality(docs, labels.where("doc_id < 12"))
    assert quality.score_documents(docs, few).count() == docs.count()


# Empty tables


def test_empty_tables(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert substring.substring_digest(empty).count() == 0
    assert mixing.mix_sources(empty).count() == 0
    assert sharding.shard_documents(empty, 40).count() == 0
    assert bpe.bpe_round_trip(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    assert cas.store_and_read(empty, WORDS).count() == 0
    assert attribution.section_token_counts(empty, RANKS, public_tokenizers.PATTERN).count() == 0


assert COPY
