"""Token ids in a content-addressed store.

Texts become id streams, one per document with an end id.  A rolling hash over
the last ids cuts a stream into chunks at content-defined places; a chunk is
named by its SHA-256 and stored once.  A document's recipe lists its chunks; the
recipes are files in ascending id order with the running start of every
document, and a manifest holds a Merkle root per segment of ``SEGMENT_ROWS`` of them.  Reading back
recomputes every chunk's name from its bytes and every root from its recipe, and
fails on any difference.

The checksum of a whole document is combined from its chunks' checksums (CRC-32
is linear), so that no document is put together in one place to verify it.

Layout below the path: ``objects`` (chunk rows with their bytes, and recipe rows
as encoded), ``recipes`` (segment, doc_id, start, n_tokens, chunk names and ends,
root), ``manifest`` (segment, first and last start, documents, ids, root).  Ids
are little-endian, two bytes where the vocabulary fits, else four.

Defined cases: a null or empty text is the end id alone; null ids come last;
rows sharing an id are documents of their own, ordered by their root; an empty
table gives no rows; other columns are ignored; the strings of special tokens in
a text are their ids, as the library's plain call has it.
"""

from __future__ import annotations

import array
import functools
import hashlib
import json
import os
import re
import sys
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rangeledger.llm.common import add_columns, cut, in_small_batches, scratch
from rangeledger.llm.text import slices, word_pieces

WINDOW = 16
CUT_MASK = 511  # one place in 512
LEAST, MOST = 64, 4096  # ids of a chunk
_KEPT_WORDS = 500_000
_KEPT_NAMES = 200_000
#: Recipes under one root of the manifest.
SEGMENT_ROWS = 4096
#: What a tokenizer file must say for its texts to be encoded word by word.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
WORD_LETTERS = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: ASCII marks but the apostrophe, which may begin a unit with letters.
MARKS = b"".join(bytes([b]) for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'")


def _byte_letters() -> list[str]:
    """The character by which a byte-level vocabulary writes each byte: itself if
    it is a visible Latin-1 character, else the next one from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordIds(dict):
    """Ids (as bytes) of white-space separated words, remembered up to a bound.

    A vocabulary that lower-cases, drops white space and never splits across ASCII
    white space gives a text the ids of its words in turn; the file is checked to
    be of that kind (``by_word``), and any other is asked for whole texts.  A plain
    word of letters, perhaps with marks behind it, is one unit of the merges (and
    the marks another), which are asked for it directly.  Special tokens stand for
    themselves wherever their strings are in a text, which is cut around them."""

    def __init__(self, tokenizer_file: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        told = json.loads(self.tokenizer.to_str())
        added = {t["content"]: t["id"] for t in told["added_tokens"]}
        plain = not any(t[flag] for t in told["added_tokens"] for flag in ("normalized", "lstrip", "rstrip", "single_word"))
        split = told["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [WORD_SPLIT, WORD_LETTERS]}
        merged = told["model"]["type"] == "BPE" and told["model"]["end_of_word_suffix"] == "</w>" and not told["model"]["dropout"]
        self.by_word = plain and split and merged and told["normalizer"] == WORD_NORMALIZER and told["post_processor"] is None
        # Words come lower-cased and cut around special tokens: what looks like one in them is text.
        self.tokenizer.encode_special_tokens = self.by_word
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.kind, self.code = np.dtype("<u2" if small else "<u4"), "H" if small else "I"
        self.merges, self.letters = self.tokenizer.model.tokenize, _byte_letters()
        self.stems: dict[bytes, bytes] = {}
        self.added = {text: self._packed([i]) for text, i in added.items()}

    def _packed(self, ids: list[int]) -> bytes:
        packed = array.array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _encoded(self, word: bytes) -> bytes:
        return self._packed(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)

    def _stem(self, word: bytes) -> bytes:
        found = self.stems.get(word)
        if found is None:
            text = word.decode()
            if text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text):
                plain = text if word.isalpha() else "".join([self.letters[b] for b in word])
                found = self._packed([t.id for t in self.merges(plain)])
            else:
                found = self._encoded(word)
            self.stems[word] = found
        return found

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > _KEPT_WORDS or len(self.stems) > _KEPT_WORDS:
            self.clear()
            self.stems.clear()
        stem = word.rstrip(MARKS)
        if len(stem) < len(word) and stem.decode().lower().isalpha():
            found = self._stem(stem) + self._stem(word[len(stem) :])
        else:
            found = self._stem(word)
        if len(word) <= 64:
            self[word] = found
        return found

    def _words(self, text: str) -> bytes:
        get = self.__getitem__
        return b"".join([b"".join(map(get, words)) for words in word_pieces(text.encode().lower())])

    def stream(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word:
            return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if self.special is None or not self.special.search(text):
            return self._words(text)
        out, at = [], 0
        for found in self.special.finditer(text):
            out += [self._words(text[at : found.start()]), self.added[found.group()]]
            at = found.end()
        return b"".join([*out, self._words(text[at:])])


@functools.lru_cache(maxsize=1)
def word_ids(tokenizer_file: str) -> WordIds:
    """One per worker process, kept from task to task."""
    return WordIds(tokenizer_file)


@functools.lru_cache
def _gear(size: int) -> np.ndarray:
    return np.random.default_rng(20).integers(0, 2**64, size, dtype=np.uint64)


def chunk_ends(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream, the last at its end."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    mixed = _gear(1 << 16)[ids & np.uint32(0xFFFF)]
    rolled = mixed.copy()
    for k in range(1, WINDOW):
        rolled[k:] += mixed[:-k] << np.uint64(k)
    places = (np.flatnonzero((rolled >> np.uint64(12)) & np.uint64(CUT_MASK) == 0) + 1).tolist()
    ends, start = [], 0
    for at in [*places, n]:
        while at - start > MOST:
            start += MOST
            ends.append(start)
        if at < n and at - start >= LEAST:
            start = at
            ends.append(at)
    if start < n:
        ends.append(n)
    return ends


def merkle_root(names: list[bytes]) -> bytes:
    """Root over the names in order; an odd last one goes up unpaired."""
    level = names or [b""]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return hashlib.sha256(b"root" + level[0]).digest()


def _objects(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """Recipe rows and chunk rows; a task gives a chunk it remembers only once."""
    id_type = docs.schema["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = word_ids(tokenizer_file), set()
        end = np.array([end_id], dtype=words.kind).tobytes()
        for batch in slices(batches):
            rows: list[tuple] = []
            for n, text in enumerate(batch.column(1)):
                data = words.stream(text.as_py()) + end
                ids = np.frombuffer(data, dtype=words.kind)
                ends, width = chunk_ends(ids), words.kind.itemsize
                names = []
                for a, b in zip([0, *ends[:-1]], ends, strict=True):
                    part = data[a * width : b * width]
                    name = hashlib.sha256(part).digest()
                    names.append(name)
                    if name not in seen:
                        if len(seen) > _KEPT_NAMES:
                            seen.clear()
                        seen.add(name)
                        rows.append((None, name, part, None, None, None, None))
                root = merkle_root(names)
                rows.append((n, root, None, len(ids), names, ends, width))
            index, key, data, count, names, ends, width = zip(*rows, strict=True)
            columns = [
                batch.column(0).take(pa.array(index, pa.int64())), pa.array([n is not None for n in index]), pa.array(key, pa.binary()), pa.array(data, pa.binary()),
                pa.array(count, pa.int64()), pa.array(names, pa.list_(pa.binary())), pa.array(ends, pa.list_(pa.int64())), pa.array(width, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    schema = add_columns(
        T.StructType([id_type]), ("is_recipe", T.BooleanType()), ("name", T.BinaryType()), ("data", T.BinaryType()), ("n_tokens", T.LongType()),
        ("chunks", T.ArrayType(T.BinaryType())), ("ends", T.ArrayType(T.LongType())), ("width", T.IntegerType()),
    )
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _stored_once(objects: DataFrame) -> DataFrame:
    """Each chunk once, recipes all: rows are dealt and sorted by name (the sort
    spills), so that equal names are neighbours."""
    own = F.when(F.col("is_recipe"), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    return objects.withColumn("own", own).repartition("name", "own").dropDuplicates(["name", "own"]).drop("own")


def write_store(docs: DataFrame, path: str, tokenizer_file: str, end_id: int) -> None:
    spark = docs.sparkSession
    _stored_once(_objects(in_small_batches(docs), tokenizer_file, end_id)).write.option("compression", "zstd").parquet(f"{path}/objects")
    recipes = spark.read.parquet(f"{path}/objects").where("is_recipe").select("doc_id", F.col("name").alias("root"), "n_tokens", "chunks", "ends", "width")
    order = [F.col("doc_id").asc_nulls_last(), F.col("root").asc()]
    placed = recipes.withColumn("tie", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(*order, F.col("tie")).sortWithinPartitions(*order, F.col("tie")).drop("tie")
    # A row's number within its range partition, and that partition's number.
    placed = placed.withColumn("at", F.monotonically_increasing_id())
    placed = cut(placed.withColumn("part", F.shiftright("at", 33)).withColumn("segment", F.expr(f"at div {SEGMENT_ROWS}")))
    sums = placed.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range partition: their number bounds the broadcast.
    offsets = sums.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    shaped = placed.join(F.broadcast(offsets), "part").select("part", "segment", "doc_id", "before", "n_tokens", "chunks", "ends", "width", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = None, 0
        for batch in batches:
            own, count = batch.column(0).to_numpy(), batch.column(4).to_numpy()
            start = np.zeros(len(count), dtype=np.int64)
            for i in range(len(count)):
                if own[i] != part:
                    part, at = own[i], batch.column(3)[i].as_py()
                start[i] = at
                at += count[i]
            yield batch.set_column(3, "start", pa.array(start)).select(schema.fieldNames())

    schema = T.StructType([T.StructField("start", T.LongType()) if f.name == "before" else f for f in shaped.schema.fields if f.name != "part"])
    shaped.mapInArrow(run, schema).write.parquet(f"{path}/recipes")
    segments = spark.read.parquet(f"{path}/recipes").select("segment", "start", "n_tokens", "root")
    segments.groupBy("segment").applyInPandas(_segment_root, "segment long, first long, last long, documents long, ids long, root binary").write.parquet(f"{path}/manifest")


def _segment_root(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("start")
    root = merkle_root([bytes(r) for r in pdf["root"]])
    return pd.DataFrame({"segment": [pdf["segment"].iloc[0]], "first": [pdf["start"].iloc[0]], "last": [pdf["start"].iloc[-1]], "documents": [len(pdf)], "ids": [pdf["n_tokens"].sum()], "root": [root]})


@functools.lru_cache
def _crc_steps() -> list[np.ndarray]:
    """Tables that move a CRC-32 over 2**k zero bytes, for k from 0."""
    base = np.array([0], dtype=np.uint32)
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1).astype(np.uint32)
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    image = (bits >> np.uint32(8)) ^ byte[bits & np.uint32(255)]
    steps = []
    for _ in range(48):
        table = np.zeros((4, 256), dtype=np.uint32)
        for q in range(4):
            for b in range(8):
                table[q] ^= np.where((np.arange(256) >> b) & 1, image[8 * q + b], base[0]).astype(np.uint32)
        steps.append(table)
        image = _moved(table, image)
    return steps


def _moved(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


def crc_before(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What each part's CRC-32 adds to that of the whole, with ``after`` bytes behind it."""
    crc = crc.astype(np.uint32)
    for k, table in enumerate(_crc_steps()):
        on = (after >> k) & 1 == 1
        if on.any():
            crc = np.where(on, _moved(table, crc), crc)
        if not (after >> (k + 1)).any():
            break
    return crc


def _crc_share(crc: str, after: Column) -> Column:
    @F.pandas_udf("long")
    def share(part: pd.Series, behind: pd.Series) -> pd.Series:
        return pd.Series(crc_before(part.to_numpy(), behind.to_numpy()).astype(np.int64))

    return share(F.col(crc), after)


def _read_chunks(objects: DataFrame, width: int | None = None) -> DataFrame:
    """name, n and crc32 (ids as four bytes) of each chunk, its name verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, crc = [], []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if hashlib.sha256(data).digest() != name:
                    raise ValueError(f"chunk {name.hex()} is damaged")
                ids = np.frombuffer(data, dtype=f"<u{width}")
                count.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(crc, pa.int64())], names=["name", "n", "crc"])

    return objects.where("not is_recipe").select("name", "data").mapInArrow(run, "name binary, n long, crc long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per stored document: doc_id, start, n_tokens, ids_crc32, all verified."""
    recipes = spark.read.parquet(f"{path}/recipes")
    first = recipes.select("width").limit(1).collect()
    chunks = _read_chunks(spark.read.parquet(f"{path}/objects"), first[0]["width"] if first else 2)

    @F.pandas_udf("boolean")
    def sound(names: pd.Series, root: pd.Series) -> pd.Series:
        return pd.Series([merkle_root([bytes(x) for x in n]) == bytes(r) for n, r in zip(names, root, strict=True)], dtype=bool)

    checked = recipes.withColumn("sound", sound("chunks", "root"))
    parts = checked.select("doc_id", "start", "n_tokens", "sound", F.posexplode(F.arrays_zip("chunks", "ends")).alias("k", "part"))
    parts = parts.select("doc_id", "start", "n_tokens", "sound", F.col("part.chunks").alias("name"), ((F.col("n_tokens") - F.col("part.ends")) * 4).alias("after"))
    found = parts.join(chunks, "name", "left").withColumn("share", _crc_share("crc", F.col("after")))
    whole = found.groupBy("start", "doc_id", "n_tokens").agg(
        F.bit_xor("share").alias("ids_crc32"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_read"), F.bool_and("sound").alias("sound")
    )
    fine = F.col("sound") & (F.col("n_read") == F.col("n_tokens"))
    count = F.when(fine, F.col("n_read")).otherwise(F.raise_error(F.lit("a document differs from its recipe")).cast("long"))
    return whole.select("doc_id", "start", count.alias("n_tokens"), "ids_crc32")


def verify_manifest(spark: SparkSession, path: str) -> bool:
    """Whether the roots of all segments come out again from the recipes."""
    again = spark.read.parquet(f"{path}/recipes").select("segment", "start", "n_tokens", "root")
    again = again.groupBy("segment").applyInPandas(_segment_root, "segment long, first long, last long, documents long, ids long, root binary")
    kept = spark.read.parquet(f"{path}/manifest")
    return not kept.exceptAll(again).count() and not again.exceptAll(kept).count()


def store_and_read(docs: DataFrame, tokenizer_file: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    path = path or scratch(spark, "token-store")
    write_store(docs, path, tokenizer_file, end_id)
    if not verify_manifest(spark, path):
        raise ValueError("the manifest differs from the recipes")
    return read_documents(spark, path)
