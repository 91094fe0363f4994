"""Quality score by compression with dictionaries of good and bad text.

Two zstandard dictionaries are trained, one from labelled good and one from
labelled bad texts.  A whole text is compressed in short blocks (so that the
dictionary counts for more than the text's own repeats) with either; the
difference of the two sizes over their sum is turned into the probability of
label 1 by logistic calibration on labelled texts not used for the dictionaries.

Fitting uses at most ``sample_rows`` labelled rows of each class (those with the
smallest hash of their id; of documents that share an id the least text).  Half
of them give at most ``text_blocks`` blocks each, drawn by hash from all over the
text, to the dictionaries: what goes to the driver is bounded by
``sample_rows * text_blocks`` blocks.  The other half calibrates: Spark compresses
their whole texts and sends two numbers a row; classes are weighed by their counts
over all labels.  Scoring covers whole texts.

Defined cases: a null text is an empty one, whose score is that of no
difference; a null id counts as the empty string in the split; rows sharing an
id in the labels count once (the lowest label); with labels of one class only,
every score is that class; with none it is 0.5; an empty table gives no rows;
labels without any of their documents give the share of label 1.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rangeledger.llm.common import cut_small, in_small_batches, lean

LEVEL = 3
BLOCK_BYTES = 512


def split_fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; fold 0 is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def _blocks(text: str | None) -> list[bytes]:
    data = (text or "").encode()
    return [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]


def drawn_blocks(text: str | None, most: int) -> list[bytes]:
    """At most ``most`` blocks of a whole text, those of least hash, in order."""
    blocks = _blocks(text)
    if len(blocks) <= most:
        return blocks
    least = heapq.nsmallest(most, range(len(blocks)), key=lambda i: zlib.crc32(blocks[i], i & 0xFFFFFFFF))
    return [blocks[i] for i in sorted(least)]


def _dictionary(blocks: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves
        return b"".join(blocks)[-size:]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    loaded = zstandard.ZstdCompressionDict(content) if content else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=loaded, write_content_size=False, write_dict_id=False, write_checksum=False)


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    offset: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = differences(self.good, self.bad, texts) if self.slope else np.zeros(len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * x + self.offset, -500, 500)))


def differences(good: bytes, bad: bytes, texts: list[str | None]) -> np.ndarray:
    """(size with bad - size with good) / sum of sizes, 0 for an empty text."""
    by_good, by_bad = _compressor(good), _compressor(bad)
    out = np.zeros(len(texts))
    for n, text in enumerate(texts):
        g = b = 0
        for block in _blocks(text):
            g += len(by_good.compress(block))
            b += len(by_bad.compress(block))
        out[n] = (b - g) / (b + g) if b + g else 0.0
    return out


def _calibrated(x: np.ndarray, label: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a weighted logistic regression, by Newton's method."""
    scale = max(float(x.std()), 1e-12)
    design, w = np.column_stack([x / scale, np.ones_like(x)]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        grad = design.T @ (weight * (p - label)) + ridge * w
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit_quality(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_rows: int = 4000, text_blocks: int = 8, dictionary_bytes: int = 65536
) -> QualityModel:
    """Fit on labelled rows outside fold 0."""
    docs = in_small_batches(docs)
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & (split_fold(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.min(F.col(label_col).cast("int")).alias("label"))
    counts = {r["label"]: r["n"] for r in known.where(F.col("label").isin(0, 1)).groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return QualityModel(b"", b"", 0.0, {0: -500.0, 1: 500.0}[next(iter(counts))] if counts else 0.0)
    picked = None
    for label in (0, 1):
        some = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
        some = some.withColumn("train", F.row_number().over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")) % 2 == 1)
        picked = some if picked is None else picked.unionByName(some)
    # At most 2 * sample_rows ids are broadcast; their texts stay on the executors.
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    rows = cut_small(rows.groupBy("doc_id", "label", "train").agg(F.min("text").alias("text")))

    @F.pandas_udf("array<binary>")
    def drawn(texts: pd.Series) -> pd.Series:
        return pd.Series([drawn_blocks(t, text_blocks) for t in texts])

    def dictionary(label: int, part: DataFrame) -> bytes:
        found = part.where(F.col("label") == label).orderBy("doc_id").select(drawn("text").alias("blocks")).collect()
        return _dictionary([bytes(b) for r in found for b in r["blocks"]], dictionary_bytes)

    good, bad = (dictionary(label, rows.where("train")) for label in (1, 0))

    @F.pandas_udf("double")
    @lean
    def difference(texts: pd.Series) -> pd.Series:
        return pd.Series(differences(good, bad, texts.tolist()))

    rest = rows.where("not train")
    both = rest.agg(F.count_distinct("label")).first()[0] == 2
    found = (rest if both else rows).select("label", difference("text").alias("x"), F.hash("doc_id").alias("h")).toPandas().sort_values(["h", "x"])
    label, x = found["label"].to_numpy(), found["x"].to_numpy()
    if len(set(label.tolist())) < 2:
        return QualityModel(good, bad, 0.0, float(np.log(counts[1] / counts[0])))
    n = {k: max(1, int((label == k).sum())) for k in (0, 1)}
    weight = np.where(label == 1, counts[1] / n[1], counts[0] / n[0]) * len(label) / (counts[0] + counts[1])
    slope, offset = _calibrated(x, label, weight)
    return QualityModel(good, bad, slope, offset)


def quality_score(model: QualityModel, text: str = "text") -> Column:
    """Probability that a whole text has label 1."""

    @F.pandas_udf("double")
    @lean
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts.tolist()))

    return score(F.col(text))


def score_documents(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = in_small_batches(docs).select("doc_id", (split_fold(F.col("doc_id")) == 0).alias("held_out"), quality_score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
