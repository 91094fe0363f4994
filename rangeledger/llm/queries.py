"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP2_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) / (q.norm * c.norm) AS score
      FROM n q JOIN n c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND q.norm > 0 AND c.norm > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def _op11_sql(rounds: int = 10, k: int = 8, dims: int = 64) -> str:
    """Lloyd's rounds written out, one pair of tables a round."""
    out = [f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1)::INTEGER AS k, e FROM (SELECT vec_id, e FROM v ORDER BY sha256('3:' || vec_id) LIMIT {k}))"""]
    for r in range(rounds + 1):
        out.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, any_value(e) AS e, arg_min(k, d * {k} + k) AS k, min(d) AS d FROM (SELECT v.vec_id, v.e, c.k, list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v CROSS JOIN c{r} c) GROUP BY vec_id)""")
        if r < rounds:
            out.append(f"""s{r} AS (SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT k, unnest(e) AS x, unnest(range({dims})) AS i FROM a{r}) GROUP BY k, i),
c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS e FROM s{r} GROUP BY k) m ON c.k = m.k)""")
    return ",\n".join(out) + f"""
SELECT a.vec_id, a.k AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.k)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.k = c.k
"""


def _op12_sql(rounds: int = 2, parts: int = 16, entries: int = 64) -> str:
    """Codebooks round by round; parts and entries are numbered from 0."""
    out = [f"""WITH f AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, p, list_slice(e, (p * len(e) // {parts} + 1)::BIGINT, ((p + 1) * len(e) // {parts})::BIGINT) AS e FROM f CROSS JOIN range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, e FROM p WHERE vec_id IN (SELECT vec_id FROM f ORDER BY vec_id LIMIT {entries}))"""]
    for r in range(rounds + 1):
        out.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, p, any_value(e) AS e, arg_min(k, d * {entries} + k) AS k, min(d) AS d FROM (SELECT v.vec_id, v.p, v.e, b.k, list_sum(list_transform(list_zip(v.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p v JOIN b{r} b ON v.p = b.p) GROUP BY vec_id, p)""")
        if r < rounds:
            out.append(f"""b{r + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(m.e, b.e) AS e FROM b{r} b LEFT JOIN (SELECT p, k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS e FROM
(SELECT p, k, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT p, k, unnest(e) AS x, unnest(range(len(e))) AS i FROM a{r}) GROUP BY p, k, i) GROUP BY p, k) m ON b.p = m.p AND b.k = m.k)""")
    return ",\n".join(out) + f"""
, h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b{rounds}),
w AS (SELECT vec_id, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT w.vec_id, code, error, sum(error) OVER (PARTITION BY f.label)::BIGINT AS label_error, codebooks_sha256 FROM w JOIN f ON w.vec_id = f.vec_id CROSS JOIN h
"""


def op1_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rangeledger.llm.topk import exact_top_k

    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, k=10, scale=1024.0)


def op2_int8_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rangeledger.llm.ann import nearest_by_cosine

    return nearest_by_cosine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, k=5)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rangeledger.llm.mixing import mix_sources

    # Longer documents are likelier to have one more copy, at most four times shorter ones.
    odds = F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.sqrt(F.col("size") / 400)))
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), weights=(5, 2, 1), share=1.5, most=2.0, tilt=odds)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rangeledger.llm.simhash import near_duplicates

    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, budget=2)
    return found.select("doc_id", "fingerprint", "component_id")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from rangeledger.llm.bpe import bpe_round_trip

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe_round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from rangeledger.llm.cas import store_and_read

    return store_and_read(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op7_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from rangeledger.llm.attribution import section_token_counts

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return section_token_counts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, rule="most")


def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rangeledger.llm.sharding import shard_documents

    placed = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rangeledger.llm.substring import substring_digest

    return substring_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=20)


def op10_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rangeledger.llm.quality import fit_quality, score_documents

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), threshold=0.3)


def op11_distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rangeledger.llm.centroids import cluster_vectors, with_cluster_facts

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    first = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    return with_cluster_facts(cluster_vectors(vectors, first, k=8, rounds=10, dims=64, scale=1024.0))


def op12_cover_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rangeledger.llm.codes import code_vectors, with_label_errors

    coded = with_label_errors(code_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), parts=16, entries=64, rounds=2, scale=256.0))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_deobfuscated_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rangeledger.llm.pii import find_pii, pii_digest

    return pii_digest(find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_ball_tree_top_k, op2_int8_tiles, op3_source_mix, op4_simhash_trie, op5_byte_bpe, op6_content_store, op7_section_tokens, op8_feistel_shards, op9_window_dedup, op10_compression_quality,
        op11_distance_matrix, op12_cover_tree_codes, op13_deobfuscated_pii,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op1_ball_tree_top_k": OP1_SQL, "op2_int8_tiles": OP2_SQL, "op11_distance_matrix": _op11_sql(), "op12_cover_tree_codes": _op12_sql()}
