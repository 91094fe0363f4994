"""Substring dedup: a count-min prefilter and exact grouping of word windows.

A window is ``width`` consecutive words.  Identical windows have the same least
hash of their inner grams (a minimiser), and each start of a window brings an
occurrence of it of its own, so counts of minimisers never fall below counts of
windows.  First pass: every task counts its minimisers in a count-min sketch,
sent as what touched its blocks; blocks are merged by sums, and a bit
per cell keeps whether two or more fell in it.  Second pass: only windows whose
minimiser is estimated at two or more in every row of the sketch are hashed
(128 bits over all their words) and grouped exactly; nothing repeated is lost.

The bits are broadcast; ``max_cells`` bounds them (16 MB a row of the sketch
at the default).  A corpus beyond it fills the cells, so that more windows reach
the exact grouping, with the same result.  Later copies of whole texts are found
by hash first and stay out of both passes (all ids whole and unique, and at most
``COPY_ROWS`` copies; else their windows are grouped like any other).

Words covered by a window that also starts earlier (smaller id, or same id and
earlier start) are removed, as judged on the input.

Defined cases: a null text has no words; null ids come last; rows with one id
and the same text are alike and neither is the earlier, rows with one id and
different texts are ordered by start, then by the text's hash; texts shorter than a window keep all; an empty table gives
no rows; other columns stay as they are, but for ``n_words``, ``n_removed`` and
``kept_text``, which the result replaces.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeledger.llm.common import add_columns, cut_small, in_small_batches, join_bounded, lean
from rangeledger.llm.text import slices

BLOCK_BITS = 20
ROWS = 2
#: Most rows of the list of later copies that is broadcast.
COPY_ROWS = 500_000
_KEPT_WORDS = 150_000
#: Texts worked on at once, which bounds a task's memory.
SLICE_ROWS = 250


class WordHashes(dict):
    """Rows of words' 128-bit hashes in a growing run of bytes, remembered up to a bound."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes = bytearray()

    def __missing__(self, word: bytes) -> int:
        row = self[word] = len(self)
        self.hashes += xxhash.xxh3_128_digest(word)
        return row

    def of(self, words: list[bytes]) -> np.ndarray:
        """n x 2 array of the words' hashes."""
        if len(self) > _KEPT_WORDS:
            self.clear()
            self.hashes.clear()
        rows = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        # A digest's bytes stand high first.
        return np.frombuffer(self.hashes, dtype=">u8").reshape(-1, 2)[rows].astype(np.uint64)


@functools.lru_cache
def _multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _grams(h: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of the ``width`` words from each position on (multilinear, mixed)."""
    n = len(h) - width + 1
    total = np.zeros(n, dtype=np.uint64)
    for k, m in enumerate(_multipliers(width, seed)):
        total += h[k : k + n] * m
    return _mix(total)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each run of ``width`` values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = pick(x[:-step], x[step:])
        done += step
    return x


def minimisers(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Per window its minimiser, and the occurrences of minimisers in the text."""
    gram = width // 2
    grams = _grams(h, gram, 1)
    span = width - gram + 1
    least = _sliding(grams, span, np.minimum)
    edge = np.zeros(span - 1, dtype=np.uint64)
    covering = _sliding(np.concatenate([edge, least, edge]), span, np.maximum)
    return least, grams[covering == grams]


def _blocks(m: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Per minimiser its block of cells and 31 bits that place it there; the bits of an offset."""
    bits = min(BLOCK_BITS, cells.bit_length() - 1)
    block = (m >> np.uint64(34)) & np.uint64((cells >> bits) - 1)
    return block.astype(np.int64), ((m >> np.uint64(3)) & np.uint64(0x7FFFFFFF)).astype("<u4"), bits


def _offsets(rest: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell within a block in either row of the sketch."""
    other = (rest * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    return [rest & np.uint32((1 << bits) - 1), other]


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def sketch_of(docs: DataFrame, width: int, cells: int) -> list[np.ndarray]:
    """Bits of the cells that two or more minimisers fell in, per row."""
    bits = min(BLOCK_BITS, cells.bit_length() - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()

        def flush(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            block, rest, _ = _blocks(np.concatenate(found), cells)
            key, n = np.unique((block << 32) | rest, return_counts=True)
            block = key >> 32
            # Its top bit is set if two or more were met here.
            packed = (key & 0x7FFFFFFF).astype("<u4") | ((n > 1).astype("<u4") << np.uint32(31))
            starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])).tolist()
            parts = [packed[s:e].tobytes() for s, e in zip(starts, [*starts[1:], len(block)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(block[starts]), pa.array(parts, pa.binary())], names=["block", "cells"])

        held: list[np.ndarray] = []
        for batch in slices(batches, SLICE_ROWS):
            for text in batch.column(0):
                words = _words(text.as_py())
                if len(words) >= width:
                    held.append(minimisers(hashes.of(words)[:, 0], width)[1])
            if sum(map(len, held)) > 1_000_000:
                yield from flush(held)
                held = []
        if held:
            yield from flush(held)

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, twice = np.zeros((ROWS, 1 << bits), dtype=bool), np.zeros((ROWS, 1 << bits), dtype=bool)
        for batch in batches:
            for part in slices([batch], 64):
                cell = np.frombuffer(b"".join(part.column("cells").to_pylist()), dtype="<u4")
                many = cell >> 31 == 1
                for row, at in enumerate(_offsets(cell & np.uint32(0x7FFFFFFF), bits)):
                    # Of several minimisers each may have met the same cell.
                    count = np.bincount(at, minlength=1 << bits)
                    twice[row] |= (count > 1) | (seen[row] & (count > 0))
                    twice[row][at[many]] = True
                    seen[row] |= count > 0
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(twice, axis=1).tobytes()], pa.binary())], names=["block", "bits"])

    touched = docs.select("text").mapInArrow(lean(count), "block long, cells binary")
    merged = touched.groupBy("block").applyInArrow(merge, "block long, bits binary")
    out = [np.zeros(cells // 8, dtype=np.uint8) for _ in range(ROWS)]
    # At most ROWS * max_cells bits in all; written first, so that the tasks run side by side.
    for r in cut_small(merged).toLocalIterator():
        got = np.frombuffer(bytes(r["bits"]), dtype=np.uint8).reshape(ROWS, -1)
        for row in range(ROWS):
            out[row][r["block"] * got.shape[1] : (r["block"] + 1) * got.shape[1]] = got[row]
    return out


def _estimated_twice(sketch: list[np.ndarray], m: np.ndarray) -> np.ndarray:
    block, rest, bits = _blocks(m, len(sketch[0]) * 8)
    twice = np.ones(len(m), dtype=bool)
    for row, at in zip(sketch, _offsets(rest, bits), strict=True):
        cell = (block << bits) | at
        twice &= (row[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
    return twice


def _suspected(h: np.ndarray, width: int, sketch: list[np.ndarray]) -> np.ndarray:
    """Starts of the windows estimated repeated."""
    return np.flatnonzero(_estimated_twice(sketch, minimisers(h[:, 0], width)[0]))


def first_windows(docs: DataFrame, width: int, sketch: Broadcast, start_bits: int) -> DataFrame:
    """doc_id, text_key and start of the first of each window estimated repeated.

    With ``start_bits`` the place of a window is one long (id, then start), whose
    least is found by hash aggregation; without, a struct that orders any ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, SLICE_ROWS):
            row, start, first, second = [], [], [], []
            for n, text in enumerate(batch.column(2)):
                words = _words(text.as_py())
                if len(words) < width:
                    continue
                h = hashes.of(words)
                at = _suspected(h, width, sketch.value)
                if len(at):
                    row.append(np.full(len(at), n))
                    start.append(at)
                    first.append(_grams(h[:, 0], width, 2)[at])
                    second.append(_grams(h[:, 1], width, 3)[at])
            if row:
                index, at = np.concatenate(row), np.concatenate(start)
                keys = [pa.array(np.concatenate(k).view(np.int64)) for k in (first, second)]
                if start_bits:
                    place = [pa.array((batch.column(0).to_numpy()[index] << start_bits) + at)]
                else:
                    place = [batch.column(0).take(pa.array(index)), batch.column(1).take(pa.array(index)), pa.array(at)]
                whole = pa.RecordBatch.from_arrays([*keys, *place], names=schema.fieldNames())
                for offset in range(0, whole.num_rows, 50_000):
                    yield whole.slice(offset, 50_000)

    long = T.LongType()
    keys = T.StructType([T.StructField("h1", long), T.StructField("h2", long)])
    if start_bits:
        schema = add_columns(keys, ("place", long))
        place = F.col("place")
    else:
        schema = add_columns(keys, ("doc_id", docs.schema["doc_id"].dataType), ("text_key", long), ("start", long))
        place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "start", "text_key")
    found = docs.select("doc_id", "text_key", "text").mapInArrow(lean(run), schema)
    least = found.groupBy("h1", "h2").agg(F.min(place).alias("place"))
    if start_bits:
        return least.select(F.shiftright("place", start_bits).alias("doc_id"), F.lit(0).cast("long").alias("text_key"), F.col("place").bitwiseAND(F.lit((1 << start_bits) - 1)).alias("start"))
    return least.select("place.doc_id", "place.text_key", "place.start")


def _kept(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Whether each of n words is kept, given the starts of windows to remove."""
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + width, -1)
    return np.cumsum(steps[:-1]) == 0


def _place_bits(docs: DataFrame) -> tuple[int, int]:
    """The bytes of all texts, and the bits a start needs if id and start
    fit one long (ids whole, unique and not negative), else 0."""
    longest, volume, null_ids = F.max(F.octet_length("text")), F.sum(F.octet_length("text").cast("long")), F.count_if(F.col("doc_id").isNull())
    whole = docs.schema["doc_id"].dataType in (T.LongType(), T.IntegerType(), T.ShortType())
    low, high = (F.min("doc_id"), F.max("doc_id")) if whole else (F.lit(-1), F.lit(-1))
    row = docs.agg(longest, volume, null_ids, low, high).first()
    bits = ((row[0] or 0) // 2 + 1).bit_length()
    fits = whole and not row[2] and row[3] is not None and row[3] >= 0 and row[4] < 1 << (62 - bits)
    fits = fits and not docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    return row[1] or 0, bits if fits else 0


def later_copies(docs: DataFrame, width: int) -> DataFrame | None:
    """doc_id of each text that stands whole under a smaller id too; None if they
    are too many to broadcast.  Only hashes and ids are shuffled."""
    hashed = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("h")).where(F.octet_length("text") >= 2 * width - 1)
    firsts = hashed.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    later = cut_small(join_bounded(hashed, cut_small(firsts), "h").where("doc_id <> first").select("doc_id"))
    return later if later.count() <= COPY_ROWS else None


def dedup_substrings(docs: DataFrame, width: int = 20, max_cells: int = 1 << 27) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text: the words kept, joined by
    one space (the original text where nothing is removed).

    What a task suspects in a text it suspects again when it removes; so only the
    first places are brought to each document, and all others suspected go.  A
    later copy of a whole text loses every word and is the first place of none,
    so it takes no part in the sketch and the grouping."""
    spark = docs.sparkSession
    docs = in_small_batches(docs).drop("n_words", "n_removed", "kept_text")
    names, schema = docs.columns, docs.schema
    id_at, text_at = names.index("doc_id"), names.index("text")
    volume, start_bits = _place_bits(docs.select("doc_id", "text"))
    # Any column name may be in docs: inside they go by number.
    base = docs.toDF(*(f"c{i}" for i in range(len(names))))
    keyed = base.withColumn("k", F.lit(0).cast("long") if start_bits else F.coalesce(F.xxhash64(f"c{text_at}"), F.lit(0)))
    light = keyed.select(F.col(f"c{id_at}").alias("doc_id"), F.col("k").alias("text_key"), F.col(f"c{text_at}").cast("string").alias("text"))
    later = later_copies(light, width) if start_bits else None
    once = light if later is None else light.join(F.broadcast(later), "doc_id", "left_anti")
    # Words take six bytes or so and minimisers are one word in six: eight cells for each.
    wanted = 1 << max(10, (volume // 36 * 8).bit_length())
    sketch = spark.sparkContext.broadcast(sketch_of(once, width, min(max_cells, wanted)))
    firsts = first_windows(once, width, sketch, start_bits).groupBy("doc_id", "text_key").agg(F.collect_list(F.col("start").cast("int")).alias("firsts"))
    marks = firsts.withColumn("copy", F.lit(False))
    if later is not None:
        marks = marks.unionByName(later.select("doc_id", F.lit(0).cast("long").alias("text_key"), F.lit(None).cast("array<int>").alias("firsts"), F.lit(True).alias("copy")))
    on = F.col(f"c{id_at}").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("text_key"))
    joined = keyed.join(marks, on, "left").select(*base.columns, "firsts", "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, SLICE_ROWS):
            total, removed, kept_text = [], [], []
            for text, first, copy in zip(batch.column(text_at), batch.column(len(names)), batch.column(len(names) + 1), strict=True):
                text = text.as_py()
                words, gone = _words(text), 0
                if len(words) >= width and copy.as_py():
                    text, gone = "", len(words)
                elif len(words) >= width:
                    later = _suspected(hashes.of(words), width, sketch.value)
                    if first.is_valid:
                        later = np.setdiff1d(later, first.values.to_numpy(zero_copy_only=False), assume_unique=True)
                    if len(later):
                        keep = _kept(len(words), later, width)
                        gone = int((~keep).sum())
                        text = b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k]).decode()
                total.append(len(words))
                removed.append(gone)
                kept_text.append(text)
            more = [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept_text, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *more], names=schema.fieldNames())

    schema = add_columns(schema, ("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_text", T.StringType()))
    return joined.mapInArrow(lean(run), schema)


def substring_digest(docs: DataFrame, width: int = 20) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    done = dedup_substrings(docs.select("doc_id", "text"), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_ROWS):
            digest = [hashlib.sha256(b" ".join(_words(t.as_py()))).hexdigest() for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    return done.select("doc_id", "n_words", "n_removed", "kept_text").mapInArrow(lean(run), schema)
