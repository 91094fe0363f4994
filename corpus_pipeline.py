"""A corpus from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  ``run`` applies them in turn, writing each
result to the shared folder and reading it as the next one's input.

Defined cases, besides those of the operators: near copies are removed by row (id
and text), rows without an id too; rows that share an id count as one document for
mixing; columns other than those of ``documents`` are dropped at the start.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeledger.llm.bpe import bpe_round_trip
from rangeledger.llm.common import cut_small, join_bounded, scratch
from rangeledger.llm.mixing import with_copies
from rangeledger.llm.quality import fit_quality, quality_score
from rangeledger.llm.simhash import row_key, similar_texts
from rangeledger.llm.substring import dedup_substrings

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
QUALITY_THRESHOLD = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.select(*COLUMNS).where(quality_score(model) >= QUALITY_THRESHOLD)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the least by id, of each group of near copies: texts
    whose five-word shingles have a Jaccard similarity of 0.8 or more are linked, as
    proposed by the SimHash trie join and confirmed on the whole texts."""
    docs = docs.select(*COLUMNS)
    marked = cut_small(similar_texts(docs, shingle=5, similarity=0.8).select("doc_id", "row_key", "root"))
    # Ids before null ids; the key settles texts that share an id.
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    least = cut_small(marked.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("root", F.col("first.row_key").alias("first_key")))
    several = join_bounded(marked, least, "root")
    losers = cut_small(several.where(F.col("row_key") != F.col("first_key")).select("row_key").distinct())
    # Rows alike in id and text have one key: of these one least row stays.
    alike = cut_small(several.where(F.col("row_key") == F.col("first_key")).groupBy("row_key").agg(F.count("*").alias("n")).where("n > 1").select("row_key"))
    kept = join_bounded(docs.withColumn("row_key", row_key()), losers, "row_key", "left_anti")
    rest = join_bounded(kept, alike, "row_key", "left_anti").select(*COLUMNS)
    once = join_bounded(kept, alike, "row_key").groupBy("row_key").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return rest.unionByName(once)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 20 words or more that stand earlier too;
    what has nothing left goes."""
    done = dedup_substrings(docs.select(*COLUMNS), width=20).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    touched = F.col("n_removed") > 0
    return done.withColumns(
        {"text": F.when(touched, F.col("kept_text")).otherwise(F.col("text")), "n_chars": F.when(touched, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))}
    ).select(*COLUMNS)


def mix_by_source(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    mixed = with_copies(docs.select(*COLUMNS), weights=(5, 2, 1), share=1.5, most=2.0).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of their decoding."""
    return bpe_round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", keep_one_of_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("source_mix", mix_by_source),
    ("byte_bpe", encode),
]

#: No SQL for compression, SimHash or BPE: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            path = scratch(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
